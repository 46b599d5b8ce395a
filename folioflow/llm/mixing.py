"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Documents are leaves of a tree of domains, languages and sources. A budget of tokens goes down the tree in proportion to integer weights. A node can take
its tokens times ``max_epochs`` at most, the sum over its leaves; what a child can't take goes to its siblings in proportion to their weights, and only
what no child can take is missing from the parent's own capacity, and so goes to the parent's siblings. Because capacities are summed
upwards first, one pass down settles all of this, with exact integers.

A leaf gets its whole epochs, and of one more epoch the longest prefix within the rest, in the order of a seeded hash that is different for each
epoch. The prefix is found without sorting the leaf: hashes fall into about ``rows / BUCKET_ROWS`` equal ranges, whose token sums are added up; only the
distinct hashes of the range in which the budget ends are ordered. Equal rows have equal hashes; as many of them are taken as the budget has room for.

Defined results: null text has no tokens; a null domain, language or source is a value of its own; rows with null or repeated doc_ids are taken or
left one by one (the hash takes in the text); of rows equal in doc_id and text, any as many as fit; an empty table gives no rows; a leaf of weight 0 gets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows that a range of hashes holds on average, and the bits of a hash.
BUCKET_ROWS, HASH_BITS = 256, 60
LEVELS = ("domain", "lang", "source")
#: Production weights: by value, 1 for others.
WEIGHTS = ({"web": 5, "books": 3, "code": 2}, {"en": 6, "de": 2, "fr": 2, "es": 1}, {})
SEED, MAX_EPOCHS, BUDGET = 17, 2, (9, 10)


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0))), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source by its number: three domains for the tables at hand."""
    k = F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("long") % 3, F.lit(0))
    return F.when(k == 1, "books").when(k == 2, "code").otherwise("web")


def _weight(column: Column, weights: dict[str, int]) -> Column:
    w = F.lit(1)
    for value, x in weights.items():
        w = F.when(column == value, x).otherwise(w)
    return w.cast("long")


def plan(leaves: DataFrame, budget: Column, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``leaves`` (domain, lang, source, rows, tokens) with ``given``: the tokens each gets of ``budget``."""
    out = leaves.withColumn("cap", F.col("tokens") * max_epochs).withColumn("given", budget.cast("long"))
    for depth, name in enumerate(LEVELS):
        keys, parents = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = out.groupBy(*keys).agg(F.sum("cap").alias("c"), F.first("given").alias("b")).withColumn("w", _weight(F.col(name), weights[depth]))
        siblings = Window.partitionBy(*parents)
        order = siblings.orderBy(F.when(F.col("w") > 0, F.col("c").cast("double") / F.col("w")).asc_nulls_last(), F.col(name).asc_nulls_first())
        # Children in the order of capacity to weight: those filled to capacity come first.
        nodes = nodes.withColumn("c0", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        nodes = nodes.withColumn("w1", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        nodes = nodes.withColumn("full", (F.col("w") > 0) & (wide("c") * wide("w1") <= wide("w") * F.greatest(wide("b") - wide("c0"), F.lit(0))))
        nodes = nodes.withColumn("cf", F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(siblings), F.lit(0))).withColumn("wf", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(siblings))
        share = F.expr("CASE WHEN full THEN c WHEN wf = 0 THEN 0 ELSE CAST((CAST(b - cf AS DECIMAL(19,0)) * CAST(w AS DECIMAL(19,0))) div CAST(wf AS DECIMAL(19,0)) AS BIGINT) END")
        nodes = nodes.select(*[F.col(k).alias(f"k_{k}") for k in keys], share.cast("long").alias("given"))
        on = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
        out = out.drop("given").join(nodes, on).drop(*[f"k_{k}" for k in keys])
    return out


def _copies_of_equal_rows(edge: DataFrame, names: list[str], into: str) -> DataFrame:
    """Of rows that are equal in key and doc_id, of which a leaf takes ``quota``: those in the first places of the written table. Whole partitions of that
    table are counted first, and rows are numbered only in the one in which the quota ends."""
    part = F.shiftright(f"{into}_row", 33)
    edge = edge.withColumn(f"{into}_part", part)
    sums = edge.groupBy(*names, f"{into}_part").agg(F.count("*").alias("n"), F.first(f"{into}_quota").alias("quota"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*names).orderBy(f"{into}_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).where("before < quota").select(*[F.col(n).alias(f"{n}_") for n in names], F.col(f"{into}_part").alias(f"{into}_part_"), "before")
    on = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names] + [F.col(f"{into}_part") == F.col(f"{into}_part_")]
    near = edge.join(sums.withColumnRenamed("before", f"{into}_before"), on)
    place = F.row_number().over(Window.partitionBy(*names, f"{into}_part").orderBy(f"{into}_row"))
    return near.withColumn(f"{into}_place", F.col(f"{into}_before") + place).where(F.col(f"{into}_place") <= F.col(f"{into}_quota")).select(f"{into}_row")


def mix(docs: DataFrame, domain: Column, into: str, seed: int = SEED, max_epochs: int = MAX_EPOCHS, budget: tuple[int, int] = BUDGET, weights=WEIGHTS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) of ``docs`` (doc_id, text, lang, source) with a struct ``into``: domain, n_tokens and copies, how often the row
    is taken. No other column of ``docs`` may have a name that begins with ``into``. The budget is a fraction of all tokens.

    Texts are cut into words once, when the rows are written with their counts and text hashes; the passes that find where prefixes end read short columns."""
    names = [f"{into}_{k}" for k in LEVELS]
    n, row, key, at = (f"{into}_{x}" for x in ("n", "row", "key", "range"))
    own = common.own(docs.select(*keep) if keep is not None else docs)
    short = [domain.cast("string").alias(names[0]), F.col("lang").alias(names[1]), F.col("source").alias(names[2]), n_tokens(F.col("text")).alias(n), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias(f"{into}_hash"), F.col("doc_id").alias(f"{into}_id")]
    rows = common.written(docs.select(*own, *short, F.monotonically_increasing_id().alias(row)), "tokens")
    leaves = rows.groupBy(*[F.col(x).alias(k) for x, k in zip(names, LEVELS)]).agg(F.count("*").alias("rows"), F.sum(n).alias("tokens"))
    leaves = common.written(leaves, "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first().t  # one number
    given = plan(leaves, F.lit(total * budget[0] // budget[1]), weights, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(0)
    ranges = F.least(F.lit(1 << 20), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("rows") / BUCKET_ROWS, F.lit(1)))))).cast("long")
    given = given.withColumn("epochs", epochs).withColumn("rest", F.col("given") - F.col("epochs") * F.col("tokens")).withColumn("size", F.lit(1 << HASH_BITS).cast("long") / ranges)
    given = common.written(given.select(*[F.col(k).alias(f"{into}_{k}_") for k in LEVELS], F.struct("epochs", "rest", F.col("size").cast("long").alias("size")).alias(f"{into}_leaf")), "plan")
    same = [F.col(x).eqNullSafe(F.col(f"{x}_")) for x in names]
    leaf = F.col(f"{into}_leaf")
    text = F.concat_ws("|", F.lit(str(seed)), leaf["epochs"].cast("string"), F.coalesce(F.col(f"{into}_id").cast("string"), F.lit("")), F.col(f"{into}_hash"))
    keyed = rows.join(given, same).drop(*[f"{x}_" for x in names]).withColumn(key, F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long"))
    keyed = keyed.withColumn(at, F.expr(f"{key} div {into}_leaf.size"))
    # Token sums of ranges, partly summed before the shuffle; then the range in which each leaf's prefix ends.
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*names).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = keyed.groupBy(*names, at).agg(F.sum(n).alias("n"), F.first(leaf["rest"]).alias("rest")).withColumn("before", before).where("before <= rest")
    ends = sums.groupBy(*names).agg(F.max_by(F.struct(F.col(at).alias("range"), "before"), at).alias("end"))
    ends = common.written(ends.select(*[F.col(x).alias(f"{x}_") for x in names], F.col("end").alias(f"{into}_end")), "ends")
    # In that range, sums of equal rows (in key and doc_id), and the first of these that isn't taken whole: how many of them are.
    end, slot = F.col(f"{into}_end"), F.struct(key, F.col(f"{into}_id").isNotNull().alias("has"), f"{into}_id")
    inside = keyed.join(ends, same).where(F.col(at) == end["range"])
    order = Window.partitionBy(*names).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = inside.groupBy(*names, slot.alias("slot")).agg(F.count("*").alias("m"), F.max(n).alias("n"), F.first(end["before"]).alias("start"), F.first(leaf["rest"]).alias("rest"))
    slots = slots.withColumn("before", F.col("start") + F.coalesce(F.sum(F.col("m") * F.col("n")).over(order), F.lit(0))).where("before + m * n > rest")
    limits = slots.groupBy(*names).agg(F.min_by(F.struct("slot", F.when(F.col("n") > 0, F.floor(F.greatest(F.col("rest") - F.col("before"), F.lit(0)) / F.greatest(F.col("n"), F.lit(1)))).otherwise(F.col("m")).alias("quota")), "slot").alias("l"))
    ends = ends.join(limits.select(*[F.col(x).alias(f"{x}__") for x in names], "l"), [F.col(f"{x}_").eqNullSafe(F.col(f"{x}__")) for x in names], "left")
    ends = common.written(ends.select(*[f"{x}_" for x in names], f"{into}_end", F.col("l.slot").alias(f"{into}_slot"), F.col("l.quota").alias(f"{into}_quota")), "ends")
    marked = keyed.join(ends, same, "left").drop(*[f"{x}_" for x in names])
    limit = F.col(f"{into}_slot")
    ready = marked.select(*names, row, f"{into}_quota").where((F.col(at) == end["range"]) & (slot == limit) & (F.col(f"{into}_quota") > 0))
    some = common.written(_copies_of_equal_rows(ready, names, into).withColumnRenamed(row, f"{row}_"), "some")
    more = F.coalesce((F.col(at) < end["range"]) | (F.col(at) == end["range"]) & (limit.isNull() | (slot < limit)), F.lit(False)) | F.col(f"{row}_").isNotNull()
    out = marked.join(some, F.col(row) == F.col(f"{row}_"), "left")
    copies = (leaf["epochs"] + more.cast("long")).alias("copies")
    return out.select(*own, F.struct(F.col(names[0]).alias("domain"), F.col(n).alias("n_tokens"), copies).alias(into))


def resample(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as they are taken, all columns as they were."""
    into = common.free_name(docs, "folio_mix")
    out = mix(docs, domain_of(F.col("source")), into)
    return out.withColumn(f"{into}_each", F.explode(F.array_repeat(F.lit(1), F.col(f"{into}.copies").cast("int")))).select(*common.own(docs))


def op4_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mix(docs, domain_of(F.col("source")), "m", keep=["doc_id", "lang", "source"])
    return out.select("doc_id", F.col("m.domain").alias("domain"), "lang", "source", F.col("m.n_tokens").alias("n_tokens"), F.col("m.copies").alias("copies"))


def _level_sql(depth: int) -> str:
    keys, parents, name = LEVELS[: depth + 1], LEVELS[:depth], LEVELS[depth]
    weight = "CASE " + " ".join(f"WHEN {name} = '{v}' THEN {w}" for v, w in WEIGHTS[depth].items()) + " ELSE 1 END" if WEIGHTS[depth] else "1"
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    up, join = ("leaves", "") if depth == 0 else (f"l{depth - 1}", "")
    order = f"ORDER BY c::DOUBLE / w, {name} NULLS FIRST"
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM n.{k}" for k in keys)
    return f"""
 n{depth} AS (SELECT {', '.join(keys)}, sum(cap)::HUGEINT AS c, first(given)::HUGEINT AS b, ({weight})::HUGEINT AS w FROM {up} GROUP BY {', '.join(keys)}),
 o{depth} AS (SELECT *, coalesce(sum(c) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0, sum(w) OVER ({part} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w1 FROM n{depth}),
 f{depth} AS (SELECT *, c * w1 <= w * greatest(b - c0, 0) AS filled FROM o{depth}),
 g{depth} AS (SELECT *, coalesce(sum(CASE WHEN filled THEN c END) OVER ({part}), 0) AS cf, sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({part}) AS wf FROM f{depth}),
 l{depth} AS (SELECT a.* EXCLUDE (given), (CASE WHEN filled THEN n.c WHEN wf = 0 THEN 0 ELSE ((n.b - cf)::HUGEINT * n.w::HUGEINT) // wf::HUGEINT END)::BIGINT AS given FROM {up} a JOIN g{depth} n ON {same})"""


#: The same selection by sorting each leaf as a whole.
OP4_SQL = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens, md5(coalesce(text, '')) AS h,
  CASE coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 3, 0) WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'web' END AS domain FROM documents),
 s AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
 leaves AS (SELECT *, tokens * {MAX_EPOCHS} AS cap, ((SELECT sum(tokens) FROM s) * {BUDGET[0]} // {BUDGET[1]})::BIGINT AS given FROM s),
 {','.join(_level_sql(k) for k in range(3))},
 p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs, given, tokens FROM l2),
 k AS (SELECT d.*, epochs, given - epochs * tokens AS rest, ('0x' || substr(md5(concat_ws('|', '{SEED}', epochs::VARCHAR, coalesce(doc_id::VARCHAR, ''), h)), 1, 15))::BIGINT AS r
   FROM d JOIN p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, domain, lang, source, n_tokens,
 (epochs + (sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY r, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) <= rest)::BIGINT)::BIGINT AS copies FROM k"""
