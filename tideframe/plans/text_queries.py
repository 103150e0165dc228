"""Queries on filings, raw pages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, texts
from ..operators.splits import settled
from .roles import rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Words by category that stand in for a user's dictionary; a word may be in two.
WORDS: dict[str, tuple[str, ...]] = {"negative": ("IDIOT", "SCUM", "LOSER", "TRASH"), "positive": ("THE", "AND", "FOR"), "uncertainty": ("OF", "IN", "THE")}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.scoreable(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, c) for c, ws in WORDS.items() for w in ws], "word string, category string")


FILINGS_SQL = "w0 AS (SELECT doc_id, source, text, regexp_extract_all(text, '[a-zA-Z]+') AS words FROM documents WHERE length(text) >= 1000), f AS (SELECT *, greatest(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: length(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) > 10)), 1) AS s FROM w0 WHERE len(words) >= 200)"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE upper(w) IN ({', '.join(repr(w) for w in ws)})) AS {c}_count" for c, ws in WORDS.items())


@query(f"""WITH {FILINGS_SQL}, x AS (SELECT doc_id, unnest(words) AS w FROM f), c AS (SELECT doc_id, {_COUNTS} FROM x GROUP BY 1)
    SELECT doc_id, len(words) AS word_count, CAST(s AS BIGINT) AS sentence_count, length(text) AS filing_size, {", ".join(f"{c}_count, round({c}_count / len(words), 6) AS {c}_pct" for c in WORDS)},
      round((positive_count - negative_count) / len(words), 6) AS net_sentiment, round(negative_count / greatest(positive_count, 1), 6) AS negativity_ratio FROM f JOIN c USING (doc_id)""")
def filing_category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = texts.category_scores(filings(spark, sf_dir), "doc_id", "text", dictionary(spark), list(WORDS))
    out = out.withColumns(texts.sentiment("negative_count", "positive_count", "word_count"))
    return rounded(out, [*[f"{c}_pct" for c in WORDS], "net_sentiment", "negativity_ratio"])


@query(f"""WITH {FILINGS_SQL}, x AS (SELECT doc_id, s, unnest(words) AS w FROM f),
    y AS (SELECT doc_id, s, w, len(regexp_extract_all(lower(w), '[aeiouy]+')) AS v FROM x),
    z AS (SELECT doc_id, s, w, greatest(v - CASE WHEN lower(w) LIKE '%e' AND v > 1 THEN 1 ELSE 0 END, 1) AS syl FROM y),
    g AS (SELECT doc_id, s, count(*) AS n, sum(syl) AS syl, count(*) FILTER (WHERE syl >= 3) AS hard, sum(length(w)) AS chars FROM z GROUP BY 1, 2)
    SELECT doc_id, round(0.4 * (n / s + 100 * hard / n), 5) AS fog_index, round(0.39 * n / s + 11.8 * syl / n - 15.59, 5) AS fk_grade, round(206.835 - 1.015 * n / s - 84.6 * syl / n, 5) AS reading_ease,
      round(5.88 * chars / n - 29.6 * s / n - 15.8, 5) AS coleman_liau, round(4.71 * chars / n + 0.5 * n / s - 21.43, 5) AS ari, round(3.0 + sqrt(CASE WHEN s >= 30 THEN hard * (30 / s) ELSE hard END), 5) AS smog,
      round(n / s, 5) AS words_a_sentence, round(syl / n, 5) AS syllables_a_word, round(hard / n, 5) AS share_complex, CAST(syl AS BIGINT) AS total_syllables FROM g""")
def filing_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = texts.readability(filings(spark, sf_dir), "doc_id", "text")
    return rounded(out, [c for c in out.columns if c not in ("doc_id", "total_syllables")], 5)


_PHRASES = {"offbalance": ("the th", "ing of"), "covenant": ("er and", "tion"), "growth": ("movie ", "de la")}
_PHRASE_SQL = {k: " + ".join(f"(length(t) - length(replace(t, '{p}', ''))) // {len(p)}" for p in v) for k, v in _PHRASES.items()}


@query(f"""WITH {FILINGS_SQL}, l AS (SELECT doc_id, lower(text) AS t, len(words) AS n FROM f), c AS (SELECT doc_id, n, {", ".join(f"{v} AS {k}_count" for k, v in _PHRASE_SQL.items())} FROM l)
    SELECT doc_id, {", ".join(f"CAST({k}_count AS BIGINT) AS {k}_count, round({k}_count / n * 10000, 5) AS {k}_per10k" for k in _PHRASES)} FROM c""")
def filing_phrase_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(texts.phrase_scores(filings(spark, sf_dir), "doc_id", "text", _PHRASES), [f"{k}_per10k" for k in _PHRASES], 5)


_STRIP = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _k, _v in texts.ENTITIES.items():
    _STRIP = f"replace({_STRIP}, '{_k.replace(chr(39), chr(39) * 2)}', '{_v.replace(chr(39), chr(39) * 2)}')"


@query(f"""SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT page_id, trim(regexp_replace(CASE WHEN regexp_matches(lower(html), '<(html|body)') THEN {_STRIP} ELSE html END, '\\s+', ' ', 'g')) AS t FROM pages) WHERE length(t) > 100""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select("page_id", texts.html_to_text(F.col("html")).alias("t")).where(F.length("t") > 100)
    return t.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents), s AS (SELECT doc_id, regexp_extract(t, '(?i)\bthe\b') AS h, t FROM t),
    b AS (SELECT doc_id, substr(t, length(regexp_extract(t, '(?is)^(.*?)\bthe\b', 1)) + 1, 400) AS b FROM s WHERE h <> ''),
    n AS (SELECT doc_id, b, substr(b, 6, 400) AS r, regexp_extract(substr(b, 6, 400), '(?i)\band\b') AS u FROM b)
    SELECT doc_id, CASE WHEN u <> '' THEN substr(b, 1, length(regexp_extract(r, '(?is)^(.*?)\band\b', 1)) + 5) ELSE b END AS section FROM n""")
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first 'the' to the next 'and', or 400 characters: the operator with other headings than a filing's."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("t"))
    return t.select("doc_id", texts.section(F.col("t"), r"(?i)\bthe\b", 400, r"(?i)\band\b").alias("section")).where("section IS NOT NULL")


_COLLAPSED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT doc_id, {_COLLAPSED} AS t FROM documents), p AS (SELECT doc_id, substr(t, 1, 200) AS a, substr(t, 201, 200) AS b, substr(t, 401, 200) AS c FROM t),
    s AS (SELECT doc_id, 'business' AS section, 'Item 1. ' || a || ' ' AS body FROM p UNION ALL SELECT doc_id, 'risk', 'ITEM 1A: ' || b || ' ' FROM p UNION ALL SELECT doc_id, 'discussion', 'Item  7. ' || c FROM p WHERE c <> '')
    SELECT doc_id, section, md5(body) AS body FROM s""")
def filing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three item headings: texts of documents, laid out as the items of a report."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    part = lambda a: F.substring("t", a, 200)
    report = F.concat(F.lit("Item 1. "), part(1), F.lit(" ITEM 1A: "), part(201), F.when(part(401) != "", F.concat(F.lit(" Item  7. "), part(401))).otherwise(F.lit(" ")))
    return texts.sections(t.select("doc_id", report.alias("text")), "doc_id", "text").withColumn("body", F.md5("body"))


@query(r"""WITH t AS (SELECT doc_id, '<p class="x">' || text || E'</p>\n \n\nForward-looking statements may\nfail.\n\n<b>end</b> Forward looking statements again.\n\n' AS t FROM documents),
    a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '(?is)forward[- ]looking statements.*?\n\s*\n', '') AS t FROM t)
    SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'))) AS body FROM a""")
def cleaned_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without tags, blank lines and the first forward-looking block, which is put into each text here."""
    block = F.lit("</p>\n \n\nForward-looking statements may\nfail.\n\n<b>end</b> Forward looking statements again.\n\n")
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('<p class="x">'), F.col("text"), block).alias("t"))
    return t.select("doc_id", F.md5(texts.cleaned(F.col("t"))).alias("body"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
    i AS (SELECT doc_id, w, unnest(range(0, len(w), 192)) AS a FROM w WHERE len(w) >= 10), p AS (SELECT doc_id, CAST(a // 192 AS INTEGER) AS chunk, list_slice(w, a + 1, a + 256) AS p FROM i)
    SELECT doc_id, chunk, CAST(len(p) AS INTEGER) AS words, md5(array_to_string(p, ' ')) AS body FROM p WHERE len(p) >= 10""")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("body", F.md5("body"))


@query("""WITH e AS (SELECT label % 4 AS filing, CASE WHEN vec_id % 3 = 0 THEN 'risk' ELSE 'mda' END AS section, embedding FROM embeddings WHERE NOT (label % 4 = 2 AND vec_id % 3 = 0)),
    u AS (SELECT filing, section, unnest(range(1, 65)) AS i, embedding FROM e), m AS (SELECT filing, section, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM u GROUP BY 1, 2, 3),
    k AS (SELECT * FROM (SELECT DISTINCT label % 4 AS filing FROM embeddings), (SELECT unnest(['risk', 'mda']) AS section))
    SELECT k.filing, k.section, round(coalesce(sum(v * v), 0), 6) AS norm2, round(coalesce(max(v) FILTER (WHERE i = 1), 0), 6) AS first FROM k LEFT JOIN m ON k.filing = m.filing AND k.section = m.section GROUP BY 1, 2""")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("filing"), F.when(F.col("vec_id") % 3 == 0, "risk").otherwise("mda").alias("section"), "embedding")
    every = e.select("filing").distinct().withColumn("section", F.explode(F.array(F.lit("risk"), F.lit("mda"))))
    out = texts.mean_vectors(e.where("NOT (filing = 2 AND section = 'risk')"), ["filing", "section"], "embedding", 64, every)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return rounded(out.select("filing", "section", norm.alias("norm2"), F.element_at("embedding", 1).alias("first")), ["norm2", "first"])


@query(f"""WITH {FILINGS_SQL}, r AS (SELECT source, date_trunc('quarter', DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER)) AS q, DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) AS d, doc_id, len(words) AS n FROM f),
    l AS (SELECT *, row_number() OVER (PARTITION BY source, q ORDER BY d DESC, n DESC, doc_id DESC) AS k FROM r)
    SELECT CAST(substr(source, 4) AS INTEGER) % 3 AS sector, last_day(CAST(q + INTERVAL 2 MONTH AS DATE)) AS stamp, median(n) AS n_words, count(DISTINCT source) AS n_entities FROM l WHERE k = 1 GROUP BY 1, 2""")
def quarterly_text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = filings(spark, sf_dir).select("doc_id", "source", (F.substring("source", 4, 9).cast("int") % 3).alias("sector"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")).alias("d"), F.size(texts.words_of(F.col("text"))).alias("n_words"))
    return joins.quarter_medians(f, "source", "sector", "d", ["n_words"], ["n_words", "doc_id"]).select("sector", "stamp", "n_words", "n_entities")


@query("""WITH d AS (SELECT source, doc_id % 2 AS half, length(text) AS n, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
    m AS (SELECT source, half, median(n) AS n_chars FROM d GROUP BY 1, 2), u AS (SELECT source, half, unnest(range(1, 65)) AS i, embedding FROM d WHERE embedding IS NOT NULL),
    v AS (SELECT source, half, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM u GROUP BY 1, 2, 3), n AS (SELECT source, half, sum(v * v) AS norm2 FROM v GROUP BY 1, 2)
    SELECT source, half, n_chars, round(coalesce(norm2, 0), 6) AS norm2 FROM m LEFT JOIN n USING (source, half)""")
def scores_and_vectors_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of a score next to mean vectors; a vector belongs to the document of its number."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 2).alias("half"), F.length("text").cast("double").alias("n_chars")).join(v, "doc_id", "left")
    out = texts.medians_and_mean_vectors(d, ["source", "half"], ["n_chars"], "embedding", 64)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return rounded(out.select("source", "half", "n_chars", norm.alias("norm2")), ["norm2"])


#: The eight categories of a dictionary of financial words, by the column of each.
CATEGORIES = {c: c.title() for c in ("negative", "positive", "uncertainty", "litigious", "strong", "weak", "moderate", "constraining")}
_DRAW = "CAST(('0x' || substr(md5(upper(w)), 1, 8))::UBIGINT % 11 AS INTEGER)"


def wide_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide dictionary in the form of the licensed one: every word of three letters and more of the texts, in a category or
    none by a draw (2009: added, -2020: taken out again, which counts as not being in it), and its syllables."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.transform(texts.words_of(F.col("text")), F.upper))).alias("word")).where(F.length("word") >= 3).distinct()
    words = words.withColumn("_k", F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % 11)
    flag = lambda i: F.when(F.col("_k") == i, "2009").when(F.col("_k") == i + 1, "-2020").otherwise("0")
    return words.select("word", *[flag(i).alias(c) for i, c in enumerate(CATEGORIES.values())], F.greatest(F.floor(F.length("word") / 3), F.lit(1)).cast("int").alias("syllables"))


@query(f"""WITH {FILINGS_SQL}, x AS (SELECT doc_id, s, unnest(words) AS w FROM f),
    y AS (SELECT doc_id, s, w, CASE WHEN length(w) >= 3 THEN {_DRAW} END AS k, len(regexp_extract_all(lower(w), '[aeiouy]+')) AS v FROM x),
    z AS (SELECT *, CASE WHEN k < 8 THEN greatest(length(w) // 3, 1) ELSE greatest(v - CASE WHEN lower(w) LIKE '%e' AND v > 1 THEN 1 ELSE 0 END, 1) END AS syl FROM y)
    SELECT doc_id, count(*) AS word_count, {", ".join(f"count(*) FILTER (WHERE k = {i}) AS {c}_count" for i, c in enumerate(CATEGORIES))}, CAST(sum(syl) AS BIGINT) AS total_syllables,
      round(0.4 * (count(*) / s + 100 * count(*) FILTER (WHERE syl >= 3) / count(*)), 5) AS fog_index FROM z GROUP BY doc_id, s""")
def dictionary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the eight categories, and readability by the dictionary's syllables for the words in it."""
    known = settled(texts.category_words(wide_dictionary(spark, sf_dir), CATEGORIES))
    out = texts.scores_by_dictionary(filings(spark, sf_dir), "doc_id", "text", known, list(CATEGORIES))
    return rounded(out.select("doc_id", "word_count", *[f"{c}_count" for c in CATEGORIES], "total_syllables", "fog_index"), ["fog_index"], 5)
