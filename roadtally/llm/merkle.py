"""Merkle manifest of a data set, with every leaf's proof, by butterfly exchange.

Leaves of a source are numbered by id and cut into aligned blocks of 16^3. A block hashes its own three
levels in arrays. Then blocks exchange round by round: the sixteen aligned groups that share a parent each hold the
root of their own group in every block, and each block gets one root of each of the other groups (from the block
with its own place in that group) and hashes the parent itself. After as many rounds as the source has levels above
its blocks, every block knows the upper part of its leaves' proofs and the source's root; no pass goes back down.
Sources exchange their roots in the same way up to the root of all. The last group of a level may hold fewer
blocks than the others; their roots are then sent to several blocks each, in bounded portions.

Numbers come from one sort by ranges: a row's place in its range, plus what the ranges before hold. Work is dealt by
(source, block), so a source of any size is spread.

Defined results: null fields hash as ``-``; null ids stand first in their source, ties of ids by leaf; repeated rows are leaves of their
own; a null source comes first; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtally.llm.common import drop_written, id_crc32, partitions, written

FANOUT, LOWER = 16, 3
BLOCK = FANOUT**LOWER
#: Leaves of a range of the sort.
RANGE_ROWS = 2_000_000
#: Receivers of one portion of a group's root.
PORTION = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(*values: Column) -> Column:
    """H of the fields: each `-` if null, else its bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def levels_of(n: Column) -> Column:
    """Levels above n nodes."""
    out = F.lit(0)
    for level in range(1, 16):
        out = out + (n > F.lit(FANOUT ** (level - 1))).cast("int")
    return out


def numbered(leaves: DataFrame) -> DataFrame:
    """Leaves with source_at (place of the source among n_sources), at (place in the source) and size (leaves of the source)."""
    spark = leaves.sparkSession
    table = written(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    ranges = max(partitions(spark), math.ceil(table.count() / RANGE_ROWS))
    rows = table.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("range", F.shiftright("row", 33)).drop("tie"), "numbered")
    drop_written(table)
    # a row for each range and each source in it: at most as many as there are ranges and sources together
    own = Window.partitionBy("source")
    part = rows.groupBy("range", "source").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    part = part.withColumn("size", F.sum("n").over(own)).withColumn("begins", F.min("range").over(own))
    part = part.withColumn("before", F.coalesce(F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("range").orderBy("first"))
    sources = part.where("range = begins").select("source", "range", nth.alias("nth"))
    new = sources.groupBy("range").agg(F.count("*").alias("new"))
    new = new.select("range", (F.sum("new").over(Window.orderBy("range")) - F.col("new")).alias("ahead"))  # a row for each range
    sources = sources.join(new, "range").select(F.col("source").alias("name"), (F.col("ahead") + F.col("nth") - 1).cast("long").alias("source_at"))
    part = part.join(sources, F.col("source").eqNullSafe(F.col("name"))).select(F.col("range").alias("of"), F.col("source").alias("named"), "first", "size", "before", "source_at")
    found = rows.join(part, (F.col("range") == F.col("of")) & F.col("source").eqNullSafe(F.col("named")))
    found = found.select("doc_id", "leaf", "changed", "source_at", "size", (F.col("row") - F.col("first") + F.col("before")).alias("at"))
    found._written_to = rows._written_to
    return found


def butterfly(nodes: DataFrame, rounds: int) -> DataFrame:
    """Proofs of all nodes of every group. nodes: (group, at, size, digest); back: (group, at, root, proof).

    proof: a structure of the joined digests before and after for each level."""
    state = nodes.withColumn("proof", F.array().cast("array<struct<before:string,after:string>>"))
    width = 1
    for _ in range(rounds):
        w, wide = F.lit(width).cast("long"), F.lit(width * FANOUT).cast("long")
        at, size = F.col("at"), F.col("size")
        state = state.withColumn("active", size > w).withColumn("base", at - at % wide).withColumn("digit", F.floor((at % wide) / w).cast("long"))
        state = state.withColumn("held", F.least(w, size - F.col("base") - F.col("digit") * w))  # nodes of the own group
        state = state.withColumn("steps", F.when(F.col("active"), F.floor((w - at % w + F.col("held") - 1) / F.col("held")).cast("long")).otherwise(F.lit(1).cast("long")))
        # a node of a short group serves every held-th place; portions keep one node's messages in several tasks
        sent = state.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("steps") - 1) / PORTION).cast("long"))))
        if width > 1:
            sent = sent.repartition("group", "at", "portion")
        step = F.sequence(F.col("portion") * PORTION, F.least(F.col("steps"), (F.col("portion") + 1) * PORTION) - 1)
        places = F.flatten(F.transform(step, lambda i: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(FANOUT - 1).cast("long")), lambda e: F.struct((F.col("base") + e * w + at % w + i * F.col("held")).alias("to"), (e * w + F.col("base")).alias("from_"), e.alias("e")))))
        low = lambda p: p["to"] - p["from_"]
        wanted = F.filter(places, lambda p: (p["to"] < size) & (low(p) < w) & ((p["e"] != F.col("digit")) | (p["to"] == at)))
        to = F.when(F.col("active"), F.transform(wanted, lambda p: p["to"])).otherwise(F.array(at))
        sent = sent.withColumn("to", F.explode(to))
        own = F.col("to") == F.col("at")
        state = sent.groupBy("group", F.col("to").alias("at"), "size").agg(
            F.sort_array(F.collect_list(F.struct("digit", "digest"))).alias("got"),  # 16 at most
            F.max(F.when(own, F.col("proof"))).alias("proof"), F.max(F.when(own, F.col("digit"))).cast("int").alias("digit"), F.max("active").alias("active"),
        )
        roots = F.transform("got", lambda g: g["digest"])
        level = F.struct(F.array_join(F.slice(roots, F.lit(1), F.col("digit")), "").alias("before"), F.array_join(F.slice(roots, F.col("digit") + 2, F.lit(FANOUT)), "").alias("after"))
        state = state.select(
            "group", "at", "size", F.when(F.col("active"), F.sha2(F.array_join(roots, ""), 256)).otherwise(roots[0]).alias("digest"),
            F.when(F.col("active"), F.concat("proof", F.array(level))).otherwise(F.col("proof")).alias("proof"),
        )
        width *= FANOUT
    return state.select("group", "at", F.col("digest").alias("root"), "proof")


def _rounds(most: int) -> int:
    out = 0
    while FANOUT**out < most:
        out += 1
    return out


def parents(level: Column) -> Column:
    """Digests one level up from an array of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * FANOUT + 1, F.lit(FANOUT)), ""), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, source_root, root, proof, changed): proof is one structure (before, after) a level; changed is the leaf as it would be, where tampered gives a text for it."""
    cols = {c: F.col(f"`{c}`") for c in FIELDS}
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull() & cols["text"].isNotNull(), leaf_hash(*[tampered if c == "text" else cols[c] for c in FIELDS]))
    leaves = docs.select(cols["doc_id"].alias("doc_id"), cols["source"].alias("source"), leaf_hash(*[cols[c] for c in FIELDS]).alias("leaf"), other.alias("changed"))
    rows = numbered(leaves)
    blocks = rows.groupBy("source_at", F.floor(F.col("at") / BLOCK).cast("long").alias("block"), "size").agg(F.sort_array(F.collect_list(F.struct("at", "doc_id", "leaf", "changed"))).alias("rows"))  # BLOCK at most
    leaf = F.transform("rows", lambda r: r["leaf"])
    blocks = blocks.withColumn("l0", leaf)
    for k in range(LOWER):
        short = F.col("size") <= FANOUT**k  # the source ends at this level
        up = parents(F.col(f"l{k}"))
        blocks = blocks.withColumn(f"l{k + 1}", F.when(short, F.col(f"l{k}")).otherwise(up))
    blocks = written(blocks.drop("l0"), "blocks")
    drop_written(rows)
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    nodes = blocks.select(F.col("source_at").alias("group"), F.col("block").alias("at"), n_blocks.alias("size"), F.col(f"l{LOWER}")[0].alias("digest"))
    most = nodes.agg(F.max("size").alias("blocks"), F.max("group").alias("last")).first()
    if most["last"] is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, source_root string, root string, proof array<struct<before:string,after:string>>, changed string")
    upper = written(butterfly(nodes, _rounds(most["blocks"])), "upper")
    tops = upper.where("at = 0").select(F.lit(0).cast("long").alias("group"), F.col("group").alias("at"), F.lit(most["last"] + 1).cast("long").alias("size"), F.col("root").alias("digest"))
    whole = butterfly(tops, _rounds(most["last"] + 1)).select(F.col("at").alias("source_at"), F.col("root").alias("whole"), F.col("proof").alias("top"))
    # a source's proof is copied for every PORTION of its blocks
    portions = upper.where(F.col("at") % PORTION == 0).select(F.col("group").alias("source_at"), F.floor(F.col("at") / PORTION).alias("portion"))
    whole = whole.join(portions, "source_at")
    upper = upper.select(F.col("group").alias("source_at"), F.col("at").alias("block"), F.col("root").alias("source_root"), "proof", F.floor(F.col("at") / PORTION).alias("portion"))
    proofs = upper.join(whole, ["source_at", "portion"]).select("source_at", "block", "source_root", F.col("whole").alias("root"), F.concat("proof", "top").alias("above"))
    found = blocks.join(proofs, ["source_at", "block"]).withColumn("l0", leaf)

    def level(k: int, i: Column) -> Column:
        """Siblings on level k of the row at place i of the block."""
        node = F.floor(i / FANOUT**k).cast("int")
        run = F.floor(node / FANOUT).cast("int") * FANOUT
        beside = F.col(f"l{k}")
        return F.struct(F.array_join(F.slice(beside, run + 1, node - run), "").alias("before"), F.array_join(F.slice(beside, node + 2, run + FANOUT - node - 1), "").alias("after"))

    deep = levels_of(F.col("size"))
    row = F.transform("rows", lambda r, i: F.struct(r["doc_id"].alias("doc_id"), r["leaf"].alias("leaf"), r["changed"].alias("changed"), F.slice(F.array(*[level(k, i) for k in range(LOWER)]), F.lit(1), F.least(deep, F.lit(LOWER))).alias("own")))
    rows = found.select("source_root", "root", "above", F.explode(row).alias("r"))
    return rows.select("r.doc_id", "r.leaf", "source_root", "root", F.concat("r.own", "above").alias("proof"), "r.changed")


def fold(leaf: Column, proof: Column) -> Column:
    """Root recomputed from a leaf and its proof."""
    return F.aggregate(proof, leaf, lambda node, p: F.sha2(F.concat(p["before"], node, p["after"]), 256))


def verify_manifest(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs, and whether a copy in which every fifth text (by the id's crc32) is in lower case still gives the root."""
    text = F.col("`text`").cast("string")
    hit = F.pmod(id_crc32(F.col("`doc_id`")), F.lit(5)) == 0
    out = manifest(docs, F.when(hit, F.translate(text, UPPER_CASE, LOWER_CASE)))
    joined = F.array_join(F.transform("proof", lambda p: F.concat(p["before"], p["after"])), "")
    folded = fold(F.coalesce("changed", "leaf"), F.col("proof"))
    out = out.select("doc_id", "leaf", F.col("source_root").alias("subroot"), "root", F.sha2(joined, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(levels: int = 5, tops: int = 4) -> str:
    """The same rows in DuckDB, for sources of up to 16^levels leaves and up to 16^tops sources."""

    def field(name: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({name} AS VARCHAR))) AS VARCHAR) || ':' || CAST({name} AS VARCHAR), '-')"

    crc = "xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    own = " || ".join(field(f) for f in FIELDS)
    other = " || ".join(field(f"translate(text, '{UPPER_CASE}', '{LOWER_CASE}')" if f == "text" else f) for f in FIELDS)
    parts = [
        f"given AS (SELECT doc_id, source, sha256({own}) AS leaf, CASE WHEN text IS NOT NULL AND {crc} % 5 = 0 THEN sha256({other}) END AS changed FROM documents)",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM given)",
        "named AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS nth FROM (SELECT DISTINCT source FROM leaves))",
        "p0 AS (SELECT leaves.doc_id, leaves.leaf, coalesce(changed, leaf) AS folded, '' AS proof, pos, nth FROM leaves JOIN named ON named.source IS NOT DISTINCT FROM leaves.source)",
        "a0 AS (SELECT nth AS grp, pos, leaf AS digest FROM p0)",
    ]

    def climb(node: str, proof: str, n: int, grp: str, at: str) -> None:
        for k in range(n):
            parts.append(f"{node}run{k} AS (SELECT grp, pos // 16 AS run, list(digest ORDER BY pos) AS d, max(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS c FROM {node}{k}) GROUP BY 1, 2)")
            parts.append(f"{node}{k + 1} AS (SELECT grp, run AS pos, CASE WHEN c > 1 THEN sha256(array_to_string(d, '')) ELSE d[1] END AS digest FROM {node}run{k})")
            place = f"({at} // {16**k}) % 16"
            before, after = f"array_to_string(d[1:{place}], '')", f"array_to_string(d[{place} + 2:], '')"
            parts.append(
                f"{proof}{k + 1} AS (SELECT p.* REPLACE (CASE WHEN c > 1 THEN sha256({before} || folded || {after}) ELSE folded END AS folded, CASE WHEN c > 1 THEN proof || {before} || {after} ELSE proof END AS proof) "
                f"FROM {proof}{k} p JOIN {node}run{k} r ON r.grp = p.{grp} AND r.run = p.{at} // {16 ** (k + 1)})"
            )

    climb("a", "p", levels, "nth", "pos")
    parts.append(f"q0 AS (SELECT p.*, digest AS subroot, 0 AS one FROM p{levels} p JOIN a{levels} a ON a.grp = p.nth)")
    parts.append(f"b0 AS (SELECT 0 AS grp, grp AS pos, digest FROM a{levels})")
    climb("b", "q", tops, "one", "nth")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified FROM q{tops}, b{tops}"
