"""Queries of the panel engine on the driver's tables, each with the SQL that gives the same rows.

Roles: daily series = lineitem by supplier and ship date; sector = the supplier's nation; market = mean of all suppliers;
bonds = lineitem rows; fundamentals = orders by customer nation and month; filings = documents; raw pages = pages; labels =
labels.quality; irregular series = events; vectors = embeddings.
"""
