"""Line de-duplication with a log-template tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.llm.common import likely_in, stored

#: Leading tokens that pick a leaf, documents a template must recur in, constant share of its tokens.
DEPTH, LEAST_DOCS, CONSTANT_SHARE = 2, 5, 0.8
ANY = "<*>"


def with_forms(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds `forms`: every line with single spaces, none at its ends, and each token that
    holds a digit as a wildcard.

    The rules run over the whole text, in generated code, and only where a text has
    something to change; the text then splits into as many forms as it has lines.
    """
    text = F.col(text_col)
    odd = F.contains(text, F.lit("  "))
    for sign in "\t\r\x0b\x0c":
        odd = odd | F.contains(text, F.lit(sign))
    df = docs.withColumn("_t1", F.when(odd, F.regexp_replace(text, "[\\x20\\x09\\x0B-\\x0D]+", " ")).otherwise(text))
    edges = F.contains("_t1", F.lit(" \n")) | F.contains("_t1", F.lit("\n "))
    df = df.withColumn("_t2", F.trim(F.when(edges, F.regexp_replace("_t1", " ?\n ?", "\n")).otherwise(F.col("_t1"))))
    masked = F.regexp_replace("_t2", "(?<![^ \n])[^ \n0-9]*[0-9][^ \n]*", ANY)
    df = df.withColumn("_t3", F.when(F.col("_t2").rlike("[0-9]"), masked).otherwise(F.col("_t2")))
    return df.withColumn("forms", F.split("_t3", "\n")).drop("_t1", "_t2", "_t3")


def _leaf(form, depth):
    """Leaf of the tree: number of tokens, then the leading tokens."""
    spaces = F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit("")))
    return F.xxhash64(spaces, F.substring_index(form, " ", depth))


def text_of(id_col, text_col):
    """A document's id, then the hash of its text; null ids come last."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias("hash"))


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, depth: int = DEPTH) -> DataFrame:
    """doc, form_hash, leaf: each distinct line form of each document, without its text."""
    told = docs.where(F.col(text_col).isNotNull()).select(text_of(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    lines = with_forms(told, "text").select("doc", F.explode(F.array_distinct("forms")).alias("form")).where("form <> ''")
    return lines.select("doc", F.unhex(F.md5("form")).alias("form_hash"), _leaf(F.col("form"), depth).alias("leaf"))


def recurring_lines(docs: DataFrame, hashed: DataFrame, id_col: str, text_col: str, depth: int = DEPTH, least_docs: int = LEAST_DOCS, share: float = CONSTANT_SHARE) -> DataFrame:
    """form, first: line forms whose template recurs; the first document that has it and its text's hash.

    Fixed-depth parsing sends a line form to the leaf of its token count and leading
    tokens.  In a leaf, a token is constant at its position if it stands there in lines
    of `least_docs` documents or more; a line's other tokens are variable fields, so its
    template has a wildcard in their place.  A line with too few constant tokens is its
    own template.  A template recurs if its lines stand in `least_docs` documents or
    more, each distinct line counted once per document.
    """
    told = docs.where(F.col(text_col).isNotNull()).select(text_of(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    lines = with_forms(told, "text").select("doc", F.explode(F.array_distinct("forms")).alias("form")).where("form <> ''")
    lines = lines.withColumn("leaf", _leaf(F.col("form"), depth))
    busy = hashed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs).select("leaf")
    busy = stored(busy, "busy-leaves")
    # Most lines stand in a leaf of their own; their texts need not travel.
    lines = likely_in(lines, F.col("leaf"), busy, F.col("leaf"))
    kept = lines.join(busy, "leaf", "left_semi").groupBy("form").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first"))
    kept = stored(kept.withColumn("id", F.xxhash64("form")), "line-forms")
    tokens = kept.select(
        "id", "docs", _leaf(F.col("form"), depth).alias("leaf"), F.posexplode(F.split("form", " ")).alias("pos", "token")
    )
    constant = tokens.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= least_docs).drop("n").withColumn("fixed", F.lit(True))
    # A form in that many documents has constant tokens only, hence is its own template.
    rare = tokens.where(F.col("docs") < least_docs).join(constant, ["leaf", "pos", "token"], "left")
    cell = F.struct("pos", F.when(F.col("fixed"), F.col("token")).otherwise(ANY).alias("token"))
    general = (
        rare.groupBy("id")
        .agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.count("fixed").alias("fixed"), F.count(F.lit(1)).alias("size"))
        .where(F.col("fixed") >= share * F.col("size"))
        .select("id", F.array_join("cells.token", " ").alias("general"))
    )
    named = kept.join(general, "id", "left").withColumn("template", F.coalesce("general", "form"))
    named = stored(named.select("form", "docs", "first", F.unhex(F.md5("template")).alias("template")), "line-templates")
    known = named.groupBy("template").agg(F.sum("docs").alias("n"), F.min("first").alias("first")).where(F.col("n") >= least_docs)
    return named.drop("first").join(known, "template").select("form", "first")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least_docs: int = LEAST_DOCS, share: float = CONSTANT_SHARE
) -> DataFrame:
    """docs with the lines of recurring templates dropped, and n_lines, n_removed (longs).

    The first document of a template, by id, and its exact copies keep the lines (so that
    copies stay copies for a later step); everywhere else they go.
    Lines are joined by their hash alone; the texts travel once, to be rewritten.  A
    line that stands in a third of all documents is one row per task when it is
    counted, and in the join it is split by adaptive execution.

    Nulls and corner cases: null text stays null (0 lines); empty text has one blank
    line; blank lines are never dropped, and a text may lose all others; a null id is
    the last in order; rows that repeat an id count as one document each, and a row
    loses what its id's rows lose; other columns pass through, whatever their names, but
    for n_lines and n_removed, which are replaced; an empty table gives no rows; a text of
    any length is split and put together as a whole, in one task.
    """
    named = [(f"c{k}", c) for k, c in enumerate(docs.columns)]
    of = {c: k for k, c in named}
    docs, id_col, text_col = docs.toDF(*[k for k, _ in named]), of[id_col], of[text_col]
    hashed = stored(hashed_lines(docs, id_col, text_col, depth), "line-hashes")
    recurring = recurring_lines(docs, hashed, id_col, text_col, depth, least_docs, share)
    recurring = stored(recurring.select(F.unhex(F.md5("form")).alias("form_hash"), F.col("first.hash").alias("first_hash")), "recurring-lines")
    lines = hashed.select(F.col("doc.id").alias("line_doc"), F.col("doc.hash").alias("hash"), "form_hash")
    lines = likely_in(lines, F.col("form_hash"), recurring, F.col("form_hash"))
    dropped = lines.join(recurring, "form_hash").where("hash <> first_hash")
    by_doc = dropped.groupBy("line_doc").agg(F.collect_set("form_hash").alias("gone_forms"))
    joined = docs.join(by_doc, docs[id_col].eqNullSafe(F.col("line_doc")), "left")
    # Only texts that lose a line are taken apart again.
    cut = with_forms(joined.withColumn("_cut", F.when(F.col("gone_forms").isNotNull(), F.col(text_col))), "_cut")
    gone = F.transform("forms", lambda x: F.array_contains(F.col("gone_forms"), F.unhex(F.md5(x))))
    cut = cut.withColumn("_gone", gone).withColumn("_lines", F.split("_cut", "\n"))
    stay = F.array_join(F.filter("_lines", lambda x, i: ~F.element_at("_gone", i + 1)), "\n")
    text = F.when(F.col("_cut").isNull(), F.col(text_col)).otherwise(stay)
    ends = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    removed = F.size(F.filter("_gone", lambda x: x))
    return cut.select(
        *[(text if k == text_col else F.col(k)).alias(c) for k, c in named if c not in ("n_lines", "n_removed")],
        F.coalesce(ends + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_cut").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"),
    )


SQL = r"""WITH lines AS (
  SELECT DISTINCT doc_id, hash, regexp_replace(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS form
  FROM (SELECT doc_id, md5(text) AS hash, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL)),
split AS (SELECT doc_id, hash, form, string_split(form, ' ') AS tok FROM lines WHERE form <> ''),
forms AS (
  SELECT form, any_value(tok) AS tok, concat_ws(' ', len(any_value(tok)), any_value(tok)[1], any_value(tok)[2]) AS leaf,
    count(*) AS docs, min({'id': doc_id, 'hash': hash}) AS first FROM split GROUP BY form),
busy AS (SELECT leaf FROM forms GROUP BY leaf HAVING sum(docs) >= 5),
kept AS (SELECT * FROM forms WHERE leaf IN (SELECT leaf FROM busy)),
tokens AS (SELECT form, leaf, docs, unnest(range(1, len(tok) + 1)) AS pos, unnest(tok) AS token FROM kept),
constant AS (SELECT leaf, pos, token FROM tokens GROUP BY leaf, pos, token HAVING sum(docs) >= 5),
general AS (
  SELECT t.form, string_agg(CASE WHEN c.token IS NULL THEN '<*>' ELSE t.token END, ' ' ORDER BY t.pos) AS template
  FROM tokens t LEFT JOIN constant c ON t.leaf = c.leaf AND t.pos = c.pos AND t.token = c.token
  GROUP BY t.form HAVING count(c.token) >= 0.8 * count(*)),
named AS (SELECT k.form, k.docs, k.first, coalesce(g.template, k.form) AS template FROM kept k LEFT JOIN general g ON k.form = g.form),
known AS (SELECT template, min(first) AS first FROM named GROUP BY template HAVING sum(docs) >= 5),
gone AS (SELECT named.form, known.first.hash AS first_hash FROM named JOIN known USING (template)),
parts AS (
  SELECT doc_id, md5(text) AS hash, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS l
  FROM documents WHERE text IS NOT NULL),
judged AS (
  SELECT p.doc_id, p.pos, p.l, g.form IS NOT NULL AND g.first_hash <> p.hash AS dropped
  FROM (SELECT *, regexp_replace(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS form FROM parts) p
  LEFT JOIN gone g ON p.form = g.form),
cleaned AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_removed,
    coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, c.text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN cleaned c USING (doc_id)"""
