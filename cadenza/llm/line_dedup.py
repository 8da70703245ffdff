"""Line deduplication by a log-template tree (operator 7), in DataFrame operations only.

A line's way through the tree is fixed: its number of tokens, then its leading tokens, each generalised to a variable if
it holds a digit. At the leaf, lines fall together into one template if all their other tokens agree once variables are
generalised, or if one third of them does, of consecutive ones. So two variable fields may stand anywhere in the rest, and
any number of them in two of its thirds. Templates are keys, not pairs of lines, and finding the documents that a template
recurs in is a hash aggregation.

How often a template has to occur depends on how many tokens its lines are known to share: ENOUGH tokens of a part, one
less of a whole line, need two documents, and each token less ten times as many lines, as short lines recur by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leading tokens that a path of the tree has after the token count.
DEPTH = 3
#: Tokens in common, leading ones included, that two lines of a part's template need.
ENOUGH = 6
VARIABLE = "<*>"


def _tokens(line: Column) -> Column:
    trimmed = F.trim(line)
    general = F.when(trimmed.rlike(r"\d"), F.regexp_replace(trimmed, r"\S*\d\S*", VARIABLE)).otherwise(trimmed)
    return F.split(F.lower(general), r"\s+")


def template_keys(lines: DataFrame) -> DataFrame:
    """(id, line, hi, lo) for each template that a row of ``lines`` (id, line, tokens) belongs to.

    hi and lo are the key; the last three bits of lo tell how many tokens the template's lines have too few in common.
    """
    size = F.size("tokens")
    tail = F.transform(F.slice("tokens", DEPTH + 1, F.greatest(size - DEPTH, F.lit(0))), lambda token: F.xxhash64(token))
    hashed = lines.select("id", "line", size.alias("size"), F.slice("tokens", 1, DEPTH).alias("path"), tail.alias("tail"))
    rest = F.size("tail")
    cuts = [F.floor(rest * k / 3).cast("int") for k in range(4)]
    parts = [F.col("tail"), *[F.slice("tail", s + 1, e - s) for s, e in zip(cuts, cuts[1:], strict=False)]]
    # hashes come after the explode: one expression with all of them is too large to be compiled
    each = hashed.select("id", "line", "size", "path", F.posexplode(F.array(*parts)).alias("kind", "part"))
    common = F.when(F.col("kind") == 0, F.col("size") + 1).otherwise(F.size("part") + DEPTH)
    lacks = F.greatest(F.lit(0), F.lit(ENOUGH) - common)
    hi, lo = (F.xxhash64(F.lit(seed), "kind", "size", "path", "part") for seed in (1, 2))
    keyed = each.filter((F.col("kind") == 0) | (F.size("part") > 0))
    return keyed.select("id", "line", hi.alias("hi"), lo.bitwiseAND(F.lit(-8).cast("long")).bitwiseOR(lacks.cast("long")).alias("lo"))


def drop_recurring_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` freed of recurring lines, and n_lines and n_dropped after all other columns.

    A template recurs if two documents have it and enough different lines of documents belong to it. It stays in the document of the least id
    that has it and is dropped from all others; lines that a single document repeats stay, and blank ones. Lines keep their order, whatever
    separates them but line feeds, and no other line changes. A null text stays null and counts no lines; a text that
    loses all lines becomes empty. Rows with a null id keep their text and count for no template. Rows that repeat an id
    are one document. Columns named n_lines or n_dropped are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*kept)
    split = F.split(text_col, "\n")
    lines = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(split).alias("line")).filter(F.col("line").rlike(r"\S"))
    tokens = lines.select("id", F.xxhash64("line").alias("line"), _tokens(F.col("line")).alias("tokens"))
    seen = template_keys(tokens).distinct()
    # lines are counted, so that both uses of ``seen`` need it as it is and Spark computes it once
    spread = seen.groupBy("hi", "lo").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    needed = 2 * F.pow(F.lit(10.0), F.col("lo").bitwiseAND(F.lit(7).cast("long")))
    recurring = spread.filter((F.col("first") < F.col("last")) & (F.col("n") >= needed)).select("hi", "lo", "first")
    # for each document the lines that it has to drop: what it shares with a document of lower id
    shared = seen.join(recurring, ["hi", "lo"]).filter(F.col("id") > F.col("first"))
    to_drop = shared.groupBy(F.col("id").alias("_document")).agg(F.collect_set("line").alias("_dropping"))
    joined = rows.join(to_drop, F.col(id_col) == F.col("_document"), "left")
    staying = F.when(F.col("_dropping").isNull(), split).otherwise(F.filter(split, lambda line: ~F.array_contains("_dropping", F.xxhash64(line))))
    out = joined.withColumn("_staying", staying)
    n_lines, n_staying = (F.coalesce(F.size(x), F.lit(0)).cast("long") for x in (split, F.col("_staying")))
    named = {c: F.col(c) for c in kept} | {text_col: F.array_join("_staying", "\n")}
    return out.select(*[named[c].alias(c) for c in kept], n_lines.alias("n_lines"), (n_lines - n_staying).alias("n_dropped"))


#: The same rows in DuckDB: template keys are the templates themselves.
LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), tokens AS (
  SELECT doc_id, pos, line,
    regexp_split_to_array(lower(regexp_replace(trim(line), '\S*\d\S*', '<*>', 'g')), '\s+') AS t
  FROM lines
), keys AS (
  SELECT doc_id, pos, line, unnest(list_filter(list_transform([
      {'kind': 0, 'part': t[4:], 'common': len(t) + 1},
      {'kind': 1, 'part': t[4:][1:m // 3], 'common': 3 + m // 3},
      {'kind': 2, 'part': t[4:][m // 3 + 1:2 * m // 3], 'common': 3 + 2 * m // 3 - m // 3},
      {'kind': 3, 'part': t[4:][2 * m // 3 + 1:m], 'common': 3 + m - 2 * m // 3}
    ], lambda k: {'kind': k.kind, 'n': len(t), 'path': t[1:3], 'part': k.part, 'lacks': greatest(0, 6 - k.common)}), lambda k: k.kind = 0 OR len(k.part) > 0)) AS k
  FROM (SELECT *, greatest(len(t) - 3, 0) AS m FROM tokens WHERE regexp_matches(line, '[^ \t-\r]'))
), first_doc AS (
  SELECT k, min(doc_id) AS first FROM keys GROUP BY k
  HAVING min(doc_id) < max(doc_id) AND count(DISTINCT {'d': doc_id, 'l': line}) >= 2 * power(10, k.lacks)
), dropped AS (
  SELECT DISTINCT doc_id, pos FROM keys JOIN first_doc USING (k) WHERE doc_id > first
), counted AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE d.pos IS NULL) AS text, count(*) AS n_lines, count(d.pos) AS n_dropped
  FROM lines l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.pos = d.pos GROUP BY l.doc_id
)
SELECT doc_id, CASE WHEN documents.text IS NOT NULL THEN coalesce(counted.text, '') END AS text, lang, source, n_chars,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents LEFT JOIN counted USING (doc_id)
"""
