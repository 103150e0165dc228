"""Scores, sections and chunks of filings, with built-in expressions over whole texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .splits import settled

#: Phrases counted where the caller gives none.
PHRASES: dict[str, tuple[str, ...]] = {"credit": ("credit line", "covenant", "refinanc"), "growth": ("record growth", "expansion", "new market")}

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([a-zA-Z]+)"), F.lit(1))


def sentence_count(text: Column) -> Column:
    """Pieces between . ! ? of more than ten characters, at least 1."""
    return F.greatest(F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.length(F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))) > 10)), F.lit(1))


def scoreable(df: DataFrame, text: str, least_chars: int = 1000, least_words: int = 200) -> DataFrame:
    """The rows of texts of at least as many characters and, unless that is 0, words."""
    long = df.where(F.length(text) >= least_chars)
    return long.where(F.regexp_count(F.col(text), F.lit("[a-zA-Z]+")) >= least_words) if least_words else long


def category_scores(df: DataFrame, key: str, text: str, dictionary: DataFrame, categories: Sequence[str]) -> DataFrame:
    """key, word_count, sentence_count, filing_size, and for each category its count and share of words.

    dictionary: (word in capitals, category). A text is split once; words are counted by (key, word) first, so that the
    join sees distinct words. A text without words has counts of 0. Each key has one row.
    """
    flags = dictionary.groupBy("word").agg(*[F.max((F.col("category") == c).cast("int")).alias(f"_{c}") for c in categories])
    own = [key, "sentence_count", "filing_size"]
    words = df.select(key, sentence_count(F.col(text)).cast("bigint").alias("sentence_count"), F.length(text).cast("bigint").alias("filing_size"), words_of(F.col(text)).alias("_words"))
    words = words.select(*own, F.explode_outer("_words").alias("word"))  # what is measured of a text is measured before its words are rows
    counts = words.groupBy(*own, F.upper("word").alias("word")).agg(F.count("word").alias("_n"))
    hit = lambda c: F.sum(F.col("_n") * F.coalesce(F.col(f"_{c}"), F.lit(0))).cast("bigint").alias(f"{c}_count")
    out = counts.join(flags, "word", "left").groupBy(*own).agg(F.sum("_n").alias("word_count"), *[hit(c) for c in categories])
    out = out.select(key, "word_count", "sentence_count", "filing_size", *[f"{c}_count" for c in categories])
    return out.withColumns({f"{c}_pct": F.when(F.col("word_count") > 0, F.col(f"{c}_count") / F.col("word_count")) for c in categories})


def sentiment(negative: str, positive: str, words: str) -> dict[str, Column]:
    n, p = F.col(negative), F.col(positive)
    return {"net_sentiment": (p - n) / F.col(words), "negativity_ratio": n / F.greatest(p, F.lit(1))}


def syllables(word: Column) -> Column:
    """Vowel groups, less one for a final e if there are more, at least 1."""
    n = F.size(F.regexp_extract_all(F.lower(word), F.lit("([aeiouy]+)"), F.lit(1)))
    return F.greatest(n - F.when(F.lower(word).endswith("e") & (n > 1), 1).otherwise(0), F.lit(1))


def readability(df: DataFrame, key: str, text: str, known: DataFrame | None = None) -> DataFrame:
    """key and Fog, grade level, reading ease, Coleman-Liau, ARI and SMOG with the averages behind them. Syllables are from
    ``known`` (word in capitals, syllables) if it has the word. They are counted once for a document's distinct word."""
    base = df.select(key, sentence_count(F.col(text)).alias("s"))
    words = df.select(key, F.explode(words_of(F.col(text))).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("c")).withColumn("syl", syllables(F.col("w")))
    if known is not None:
        words = words.join(known.select(F.col("word").alias("_k"), F.col("syllables").alias("_s")).dropDuplicates(["_k"]), F.upper("w") == F.col("_k"), "left").withColumn("syl", F.coalesce("_s", "syl"))
    c = F.col("c")
    sums = words.groupBy(key).agg(F.sum(c).alias("n"), F.sum(c * F.col("syl")).alias("syl"), F.sum(F.when(F.col("syl") >= 3, c).otherwise(0)).alias("hard"), F.sum(c * F.length("w")).alias("chars")).join(base, key)
    return sums.select(key, *_indices())


def _indices() -> list[Column]:
    """The readability of a text of n words (NULL without any) and s sentences, with syl syllables, hard words of three and more, chars letters."""
    n, s = F.nullif(F.col("n"), F.lit(0)), F.col("s")
    aws, asp, hard, cpw = n / s, F.col("syl") / n, F.col("hard") / n, F.col("chars") / n
    smog = F.when(n.isNotNull(), 3.0 + F.sqrt(F.when(s >= 30, F.col("hard") * (30 / s)).otherwise(F.col("hard"))))
    return [
        (0.4 * (aws + 100 * hard)).alias("fog_index"),
        (0.39 * aws + 11.8 * asp - 15.59).alias("fk_grade"),
        (206.835 - 1.015 * aws - 84.6 * asp).alias("reading_ease"),
        (5.88 * cpw - 29.6 * s / n - 15.8).alias("coleman_liau"),
        (4.71 * cpw + 0.5 * aws - 21.43).alias("ari"),
        smog.alias("smog"),
        aws.alias("words_a_sentence"),
        asp.alias("syllables_a_word"),
        hard.alias("share_complex"),
        F.col("syl").cast("bigint").alias("total_syllables"),
    ]


def scores_by_dictionary(df: DataFrame, key: str, text: str, known: DataFrame, categories: Sequence[str], few: int = 200_000) -> DataFrame:
    """key, word_count, the count of each category and what ``readability`` gives, by ``known`` (word in capitals, category,
    syllables). Each key has one row.

    What is known of the ``few`` most frequent words goes to the texts, whose words are added up where they are: a task passes
    on a row a text. Only the other words, which are rare however many there are, are shuffled to meet the dictionary.
    """
    flags = known.groupBy(F.col("word").alias("w")).agg(F.min("syllables").alias("_s"), *[F.max((F.col("category") == c).cast("int")).alias(f"_{c}") for c in categories])
    syl = F.coalesce("_s", syllables(F.col("w")))  # letters alone, so capitals are as good
    own = df.select(key, sentence_count(F.col(text)).alias("s"), words_of(F.col(text)).alias("_words"))
    words = own.select(key, "s", F.explode_outer("_words").alias("w")).withColumn("w", F.upper("w"))
    usual = words.where("w IS NOT NULL").groupBy("w").count().orderBy(F.desc("count"), "w").limit(few).select("w")
    table = settled(usual.join(flags, "w", "left").withColumn("syl", syl).drop("_s").withColumn("_usual", F.lit(True)))
    found = words.join(F.broadcast(table), "w", "left")
    near = found.where("_usual OR w IS NULL")
    far = found.where("_usual IS NULL AND w IS NOT NULL").select(key, "s", "w").join(flags, "w", "left").withColumn("syl", syl)
    hits = [F.sum(F.coalesce(F.col(f"_{x}"), F.lit(0))).alias(f"{x}_count") for x in categories]
    sums = [F.count("w").alias("n"), F.sum("syl").alias("syl"), F.sum(F.when(F.col("syl") >= 3, 1).otherwise(0)).alias("hard"), F.sum(F.length("w")).alias("chars"), *hits]
    both = near.groupBy(key, "s").agg(*sums).unionByName(far.groupBy(key, "s").agg(*sums))
    total = both.groupBy(key, "s").agg(*[F.sum(c).alias(c) for c in both.columns if c not in (key, "s")])
    return total.select(key, F.col("n").alias("word_count"), *[f"{x}_count" for x in categories], *_indices())


def phrase_count(text: Column, phrases: Sequence[str], whole_words: bool = False) -> Column:
    """Occurrences in the lower-cased text, not overlapping; parts of words count unless ``whole_words``."""
    low, total = F.lower(text), F.lit(0)
    for p in phrases:
        if whole_words:
            total = total + F.regexp_count(low, F.lit(rf"\b\Q{p}\E\b"))
        else:
            total = total + ((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p)).cast("int")
    return total


def phrase_scores(df: DataFrame, key: str, text: str, lists: Mapping[str, Sequence[str]] = PHRASES) -> DataFrame:
    n = F.size(words_of(F.col(text)))
    counted = df.select(key, n.alias("_n"), *[phrase_count(F.col(text), p).cast("bigint").alias(f"{k}_count") for k, p in lists.items()])
    return counted.select(key, *[f"{k}_count" for k in lists], *[F.when(F.col("_n") > 0, F.col(f"{k}_count") / F.col("_n") * 10000).alias(f"{k}_per10k") for k in lists])


def html_to_text(html: Column) -> Column:
    """Text between tags, joined by spaces, without script and style, white space collapsed. Only if there is an <html or
    <body tag are tags taken out. Entities decoded: those of ENTITIES, the ampersand last."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for k, v in ENTITIES.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    t = F.when(F.lower(html).rlike("<(html|body)"), t).otherwise(html)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def section(text: Column, heading: str, most: int = 50_000, until: str = r"(?i)\bitem\s+\d") -> Column:
    """From the first match of the heading to the next item heading, or for ``most`` characters; NULL without a match."""
    start = F.regexp_instr(text, F.lit(heading))
    body = F.substring(text, start, F.lit(most))
    rest = F.substring(body, F.lit(6), F.lit(most))  # past the heading's own word
    nxt = F.regexp_instr(rest, F.lit(until))
    return F.when(start > 0, F.when(nxt > 0, F.substring(body, F.lit(1), nxt + 4)).otherwise(body))


#: Item headings of annual reports: business, risk factors, management's discussion.
HEADINGS: dict[str, str] = {"business": r"(?i)\bitem\s+1\s*[.:]", "risk": r"(?i)\bitem\s+1a\s*[.:]", "discussion": r"(?i)\bitem\s+7\s*[.:]"}


def sections(df: DataFrame, key: str, text: str, headings: Mapping[str, str] = HEADINGS, most: int = 50_000, until: str = r"(?i)\bitem\s+\d") -> DataFrame:
    """(key, section, body): a row for each heading that a text has."""
    parts = F.array(*[F.struct(F.lit(k).alias("section"), section(F.col(text), h, most, until).alias("body")) for k, h in headings.items()])
    return df.select(key, F.explode(parts).alias("_s")).select(key, "_s.section", "_s.body").where("body IS NOT NULL")


def category_words(dictionary: DataFrame, categories: Mapping[str, str]) -> DataFrame:
    """(word in capitals, category, syllables) from a wide dictionary: a word column, a number by category column that is not
    0 if the word is in it (the year it was added, negative if it was taken out), and syllables. categories: name -> column."""
    each = F.array(*[F.struct(F.lit(k).alias("category"), F.col(c).cast("double").alias("_in")) for k, c in categories.items()])
    rows = dictionary.select(F.upper(F.trim("word")).alias("word"), F.col("syllables").cast("int").alias("syllables"), F.explode(each).alias("_c"))
    return rows.where("_c._in > 0").select("word", "_c.category", "syllables").distinct()


def cleaned(text: Column, block: str = r"(?is)forward[- ]looking statements.*?\n\s*\n") -> Column:
    """Without tags, runs of blanks and blank lines, and the first block of the pattern."""
    t = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    at = F.regexp_instr(t, F.lit(block))
    found = F.regexp_extract(t, f"({block})", 1)
    t = F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + F.length(found), F.length(t)))).otherwise(t)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n\s*\n+", "\n"))


def chunks(df: DataFrame, key: str, text: str, size: int = 256, step: int = 192, least: int = 10) -> DataFrame:
    """(key, chunk, words, body): runs of ``size`` words, a new one every ``step``, of at least ``least`` words."""
    words = df.select(key, F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") >= least)
    parts = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step)), lambda i: F.slice("w", i + 1, F.lit(size)))
    long = words.select(key, F.posexplode(parts).alias("chunk", "part")).where(F.size("part") >= least)
    return long.select(key, "chunk", F.size("part").alias("words"), F.array_join("part", " ").alias("body"))


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str, size: int, every: DataFrame | None = None) -> DataFrame:
    """The mean vector of each key; with ``every`` (keys), a zero vector for a key that has none."""
    one = df.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    out = one.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(vector))
    if every is not None:
        out = every.select(*keys).distinct().join(out, list(keys), "left").withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0.0), size)))
    return out


def medians_and_mean_vectors(df: DataFrame, keys: Sequence[str], scores: Sequence[str], vector: str, size: int) -> DataFrame:
    """A row a key: the median of each score and the mean vector; a zero vector where no row of the key has one."""
    medians = df.groupBy(*keys).agg(*[F.median(c).alias(c) for c in scores])
    vectors = mean_vectors(df.where(F.col(vector).isNotNull()), keys, vector, size, df)
    return medians.join(vectors, list(keys))
