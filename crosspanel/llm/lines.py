"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of ``WINDOW`` neighbouring lines (blank ones are passed over) runs along every text. A chunk goes on as long as its
rolling hash occurs elsewhere in the whole table, and ends where it does not, so its boundaries depend on the lines alone and
lie alike wherever a passage stands. Windows with equal hashes are compared byte by byte, and all lines of a repeated window go but
those of its first occurrence (smallest id, then place): every passage of two or more lines is found, whatever surrounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import col, fresh, stored

WINDOW = 2
#: Code points that the lines of a window have together; shorter ones repeat by chance.
MIN_CHARS = 40
MODULUS = 2_147_483_647
BASES = (1_000_003, 998_244_353)
#: What a blank line consists of.
BLANK = " \t\r"


def _places(lines):
    """Indices of the lines that are not blank."""
    return F.filter(F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(BLANK)) != "", i)), lambda i: i.isNotNull())


def _body(lines, places, p):
    """The bytes of the window that begins with the p-th line."""
    return F.concat_ws("\n", *[F.get(lines, F.get(places, p + k)) for k in range(WINDOW)])


def lined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (hash of the text), lines, places of the lines that are not blank."""
    rows = docs.filter(col(text_col).isNotNull()).select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("key"), F.split(col(text_col), "\n", -1).alias("lines"))
    return rows.withColumn("places", _places(F.col("lines")))


def windows(rows: DataFrame) -> DataFrame:
    """(id, key, p, code): the rolling hash of every window of enough code points."""
    digests = F.transform("places", lambda i: F.struct(F.md5(F.get(F.col("lines"), i)).alias("m"), F.length(F.get(F.col("lines"), i)).alias("n")))
    # 28-bit line hashes keep every product within 64 bits
    hashed = F.transform(digests, lambda x: F.struct(*[F.conv(F.substring(x["m"], 1 + 7 * k, 7), 16, 10).cast("long").alias(f"h{k}") for k in range(2)], x["n"].alias("n")))
    rows = rows.select("id", "key", hashed.alias("h"))

    def window(x, p):
        parts = [F.get(F.col("h"), p + k) for k in range(WINDOW)]
        rolling = [sum((parts[k][f"h{b}"] * F.lit(pow(BASES[b], WINDOW - 1 - k, MODULUS)) for k in range(WINDOW)), F.lit(0).cast("long")) % MODULUS for b in range(2)]
        return F.struct(p.alias("p"), (rolling[0] * F.lit(2**31) + rolling[1]).alias("code"), sum((y["n"] for y in parts), F.lit(0)).alias("n"))

    found = F.explode(F.filter(F.transform("h", window), lambda w: w["code"].isNotNull() & (w["n"] >= MIN_CHARS)))
    return rows.select("id", "key", found.alias("w")).select("id", "key", "w.p", "w.code")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, joined, gone): the windows of a document that occur elsewhere too, and those among them that stand elsewhere before."""
    rows = lined(docs, id_col, text_col)
    occurrences = stored(windows(rows), "windows")
    # written first, so that a join with a hot code can be split
    often = stored(occurrences.groupBy("code").count().filter("count > 1").select("code"), "often")
    # candidates by document, then their bytes, which are compared by grouping on them
    wanted = occurrences.join(often, "code").groupBy("id", "key").agg(F.collect_set("p").alias("ps"))
    text = rows.alias("d").join(wanted.alias("w"), F.expr("d.id <=> w.id AND d.key = w.key")).select("d.id", "d.key", "d.lines", "d.places", "w.ps")
    bodies = text.select("id", "key", "lines", "places", F.explode("ps").alias("p")).select("id", "key", "p", _body(F.col("lines"), F.col("places"), F.col("p")).alias("body"))
    # equal bytes have equal digests: the digest stands for the bytes only after these have been grouped
    place = F.struct("id", "key", "p")
    equal = bodies.groupBy(F.md5("body").alias("hex"), "body").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    equal = stored(equal.filter("NOT (first <=> last)").select(F.unhex("hex").alias("digest"), F.xxhash64("body").alias("check"), "first"), "repeated")
    told = stored(bodies.select("id", "key", "p", F.unhex(F.md5("body")).alias("digest"), F.xxhash64("body").alias("check")), "told")
    later = told.join(equal, ["digest", "check"])
    return later.groupBy("id", "key").agg(F.collect_set("p").alias("joined"), F.collect_set(F.when(~place.eqNullSafe(F.col("first")), F.col("p"))).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with repeated chunks of lines removed from its texts.

    Adds n_lines, n_chunks (runs of lines that are not blank, joined by repeated windows) and n_removed (lines), under names the table does not have
    yet (a taken name gets an underscore). A null text stays null with zeros; an empty text is one empty line. Of equal windows the one
    with the smallest id stays, then the one standing first; blank lines stay. Rows that agree in id and text are one document and share
    its result, and a null id counts as smaller than any other. A text of repeated lines alone becomes empty; no row is dropped.
    """
    names = {n: fresh(docs, n) for n in ("n_lines", "n_chunks", "n_removed", "joined_", "gone_", "key_", "lines_", "places_")}
    found = repeated_windows(docs, id_col, text_col)
    left = docs.withColumn(names["key_"], F.xxhash64(col(text_col))).alias("d")
    found = found.select(F.col("id").alias("r_id"), F.col("key").alias("r_key"), F.col("joined").alias("r_joined"), F.col("gone").alias("r_gone")).alias("r")
    both = left.join(found, F.col(f"d.`{id_col}`").eqNullSafe(F.col("r.r_id")) & (F.col(f"d.`{names['key_']}`") == F.col("r.r_key")), "left")
    both = both.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("r.r_joined").alias(names["joined_"]), F.col("r.r_gone").alias(names["gone_"]))
    rows = both.withColumn(names["lines_"], F.split(col(text_col), "\n", -1))
    rows = rows.withColumn(names["places_"], _places(col(names["lines_"])))
    lines, places, gone = col(names["lines_"]), col(names["places_"]), col(names["gone_"])
    removed = F.array_distinct(F.flatten(F.transform(gone, lambda p: F.array(*[F.get(places, p + k) for k in range(WINDOW)]))))
    rows = rows.withColumn(names["key_"], removed)
    removed = col(names["key_"])
    left = F.array_except(F.transform(lines, lambda x, i: i), removed)
    new = {text_col: F.when(F.size(gone) > 0, F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")).otherwise(col(text_col))}
    out = [new.get(c, col(c)).alias(c) for c in docs.columns]
    size = lambda a: F.coalesce(F.when(a.isNotNull(), F.size(a)), F.lit(0)).cast("long")
    return rows.select(*out, size(lines).alias(names["n_lines"]), (size(places) - size(col(names["joined_"]))).alias(names["n_chunks"]), size(removed).alias(names["n_removed"]))


#: The digest of the result in DuckDB; ids are unique in the given tables.
DIGEST_SQL = f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l),
n AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j
      FROM x WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
w AS (SELECT doc_id, i, j, p, count(*) OVER (PARTITION BY line, after) AS n, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, p) AS k
      FROM n WHERE after IS NOT NULL AND length(line) + length(after) >= {MIN_CHARS}),
g AS (SELECT doc_id, i FROM w WHERE k > 1 UNION SELECT doc_id, j FROM w WHERE k > 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM x ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l.lines), 0)::BIGINT AS n_lines, (coalesce(a.n, 0) - coalesce(b.n, 0))::BIGINT AS n_chunks, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM n GROUP BY doc_id) a USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM w WHERE n > 1 GROUP BY doc_id) b USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) c USING (doc_id)
"""
