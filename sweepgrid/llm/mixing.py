"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source). A budget of tokens goes down the tree: at each node it is
split among the children by weight, no child gets more than its capacity (its tokens times
``max_epochs``), and what a child cannot take goes to its siblings by weight. As a node's capacity
is the sum of its leaves', a shortage leaves a node only when all below it are full: siblings come
before ancestors. All of it is integer arithmetic in windows over the children of a node.

A leaf with budget b and t tokens gives b div t whole epochs and a token prefix of one more. Every
epoch has its own order, by md5 of seed, epoch and id. Prefix sums take two levels: totals of 4,096
ranges of the order find the range in which the prefix ends, and only its rows are summed one by
one, so a leaf that holds most rows is never one task's work. That gives each leaf the row of its
cut, and one pass over the documents compares each with it; texts are shuffled only where there are
more leaves than are broadcast.

Defined cases: tokens are words ``[^\\x20\\x09-\\x0D]+``; null texts have none and are never taken;
null languages or sources are values of their own, of the default weight; a null ``doc_id`` is
ordered as "null"; repeated ids are rows of their own, ordered by the digest of their text, equal ones
by their place in the input; an empty table gives an empty result. Further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sweepgrid.llm.shared import materialise, table

SEED, MAX_EPOCHS = 17, 3
#: Parts of the budget, relative to the siblings that exist.
DOMAIN_WEIGHTS = {"web": 40, "books": 30, "reference": 20, "forum": 10}
LANGUAGE_WEIGHTS = {"en": 55, "de": 20, "fr": 15, "es": 10}
DEFAULT_WEIGHT = 10
#: Leaves up to which their table is broadcast; beyond it is joined by key.
BROADCAST_LEAVES = 50_000
RANGES = 4096
_LEAF = ["__domain", "__lang", "__source"]


def domain_of(source: str = "source") -> Column:
    """Sources are dealt to the domains by their number; those without one are ``web``."""
    names = F.array(*[F.lit(d) for d in DOMAIN_WEIGHTS])
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "web").otherwise(F.element_at(names, (F.when(number == "", "0").otherwise(number).cast("int") % len(DOMAIN_WEIGHTS) + 1).cast("int")))


def weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for k, v in weights.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out.cast("bigint")


def fill(children: DataFrame, parent: list[str], child: str, weights: Column, out: str) -> DataFrame:
    """Split ``budget`` of each parent among its children (columns ``capacity`` and weight) as ``out``.

    In the order of capacity per weight, a child is full when its share of what the ones before
    left is no less than its capacity; full children are a prefix of that order.
    """
    c = children.withColumn("__w", weights)
    order = Window.partitionBy(*parent).orderBy((F.col("capacity").cast("double") / F.col("__w")).asc(), F.col(child).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    c = c.withColumn("__c", F.coalesce(F.sum("capacity").over(before), zero)).withColumn("__r", F.sum("__w").over(after))
    c = c.withColumn("__full", (F.col("budget") - F.col("__c")) * F.col("__w") >= F.col("capacity") * F.col("__r"))
    whole = Window.partitionBy(*parent)
    c = c.withColumn("__left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("capacity"))).over(whole), zero))
    c = c.withColumn("__open", F.when(~F.col("__full"), F.col("__w")).otherwise(zero)).withColumn("__total", F.sum("__open").over(whole))
    c = c.withColumn("__upto", F.sum("__open").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    share = F.expr("(__left * __upto) div nullif(__total, 0) - (__left * (__upto - __open)) div nullif(__total, 0)")
    return c.withColumn(out, F.when(F.col("__full"), F.col("capacity")).otherwise(share)).drop("__w", "__c", "__r", "__full", "__left", "__open", "__total", "__upto")


def _joined(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on keys of which null is a value like others."""
    side = side.withColumnsRenamed({k: f"{k}_of" for k in keys})
    met = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    return rows.join(F.broadcast(side) if small else side, met, how).drop(*[f"{k}_of" for k in keys])


def leaf_budgets(leaves: DataFrame, fraction: float, max_epochs: int) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with ``leaf_budget``."""
    leaf = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    langs = leaf.groupBy("__domain", "__lang").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("__domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    total = Window.partitionBy(F.lit(0))
    domains = domains.withColumn("budget", F.least(F.floor(F.sum("tokens").over(total) * F.lit(fraction)).cast("bigint"), F.sum("capacity").over(total))).withColumn("__root", F.lit(0))
    domains = fill(domains, ["__root"], "__domain", weight("__domain", DOMAIN_WEIGHTS), "domain_budget")
    langs = _joined(langs, domains.select("__domain", F.col("domain_budget").alias("budget")), ["__domain"])
    langs = fill(langs, ["__domain"], "__lang", weight("__lang", LANGUAGE_WEIGHTS), "lang_budget")
    leaf = _joined(leaf, langs.select("__domain", "__lang", F.col("lang_budget").alias("budget")), ["__domain", "__lang"])
    return fill(leaf, ["__domain", "__lang"], "__source", F.lit(1).cast("bigint"), "leaf_budget").select(*_LEAF, "tokens", "leaf_budget")


def mixed(docs: DataFrame, carry: tuple[str, ...] = (), fraction: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED, broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """One row per document and epoch taken: the carried columns, __id, __domain, __lang, __source,
    __n (tokens), __epoch, __taken (tokens taken) and __budget (the leaf's)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a filter on the count would count twice, and regexp_count lists a text's words; without such a list, every word and the blanks around it are one letter
    some = docs.where(text.rlike("[^\\x20\\x09-\\x0D]"))
    n = F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*", "w"))
    base = some.select(
        F.col("doc_id").cast("bigint").alias("__id"), domain_of().alias("__domain"), F.col("lang").alias("__lang"), F.col("source").alias("__source"),
        n.cast("bigint").alias("__n"), F.md5(F.encode(text, "UTF-8")).alias("__md5"), F.monotonically_increasing_id().alias("__at"), *[F.col(f"`{c}`") for c in carry],
    )
    base = materialise(base, "mixing")
    leaves = materialise(leaf_budgets(base.groupBy(*_LEAF).agg(F.sum("__n").alias("tokens")), fraction, max_epochs), "leaves")
    small = leaves.count() <= broadcast_leaves
    leaves = leaves.select(*_LEAF, F.col("leaf_budget").alias("__budget"), F.expr("leaf_budget div tokens").alias("__whole"), F.expr("leaf_budget % tokens").alias("__rest"))
    key = F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), F.col("__whole").cast("string"), F.coalesce(F.col("__id").cast("string"), F.lit("null"))), "UTF-8"))
    # where the last epoch ends: the range by sums over ranges, then the row by sums over the range's rows; texts take no part
    rows = _joined(base.select("__id", *_LEAF, "__n", "__md5", "__at"), leaves.where("__rest > 0").drop("__budget"), _LEAF, small=small)
    rows = rows.withColumn("__key", key).withColumn("__range", F.conv(F.substring("__key", 1, 3), 16, 10).cast("int")).drop("__id", "__whole")
    totals = rows.groupBy(*_LEAF, "__rest", "__range").agg(F.sum("__n").alias("__sum"))
    upto = F.sum("__sum").over(Window.partitionBy(*_LEAF).orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = totals.withColumn("__upto", upto).where("__upto >= __rest AND __upto - __sum < __rest").select(*_LEAF, F.col("__range").alias("__end"), (F.col("__upto") - F.col("__sum")).alias("__before"))
    inside = _joined(rows, ends, _LEAF, small=small).where("__range = __end")
    upto = F.col("__before") + F.sum("__n").over(Window.partitionBy(*_LEAF).orderBy("__key", "__md5", "__at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = inside.withColumn("__upto", upto).where("__upto >= __rest AND __upto - __n < __rest")
    cuts = cuts.select(*_LEAF, F.struct("__key", "__md5", "__at").alias("__cut"), (F.col("__rest") - F.col("__upto") + F.col("__n")).alias("__part"))
    # the key tells ids apart, so each row knows by itself whether it lies before the cut of its leaf
    leaves = _joined(leaves, cuts, _LEAF, "left", small)
    rows = _joined(base, leaves, _LEAF, small=small).withColumn("__own", F.struct(key.alias("__key"), F.col("__md5"), F.col("__at")))
    epochs = F.col("__whole") + F.coalesce(F.col("__own") <= F.col("__cut"), F.lit(False)).cast("bigint")
    rows = rows.withColumn("__epochs", epochs).where("__epochs > 0")
    rows = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__epochs") - 1)))
    rows = rows.withColumn("__taken", F.when((F.col("__epoch") == F.col("__whole")) & (F.col("__at") == F.col("__cut.__at")), F.col("__part")).otherwise(F.col("__n")))
    return rows.select(*[F.col(f"`{c}`") for c in carry], "__id", *_LEAF, "__n", "__epoch", "__taken", "__budget")


def keep_mix(docs: DataFrame, fraction: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs`` taken, once for each epoch, with all their columns; a row taken in part
    keeps that prefix of its words (and its ``n_chars``). The columns may have any names."""
    names = docs.columns
    own = [f"carried_{i}" for i in range(len(names))]
    at = {n.lower(): c for n, c in zip(names, own)}
    held = docs.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, own)])
    held = held.select("*", *[F.col(at[n]).alias(n) for n in ("doc_id", "text", "lang", "source")])
    out = mixed(held, tuple(own), fraction, max_epochs)
    part, text = F.col("__taken") < F.col("__n"), at["text"]
    words = F.regexp_extract_all(F.col(text), F.lit("([^\\x20\\x09-\\x0D]+)"), 1)
    out = out.withColumn(text, F.when(part, F.array_join(F.slice(words, F.lit(1), F.col("__taken").cast("int")), " ")).otherwise(F.col(text)))
    if (chars := at.get("n_chars")) is not None:
        out = out.withColumn(chars, F.when(part, F.length(text)).otherwise(F.col(chars)).cast(held.schema[chars].dataType))
    return out.select(*[F.col(c).alias(n) for n, c in zip(names, own)])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select(F.col("__id").alias("doc_id"), F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__n").alias("n_tokens"), F.col("__epoch").alias("epoch"), F.col("__taken").alias("taken"), F.col("__budget").alias("leaf_budget"))


def _fill_sql(name: str, of: str, parent: str, child: str, weights: str, out: str) -> str:
    w = f"PARTITION BY {parent} ORDER BY capacity::DOUBLE / w, {child} NULLS FIRST"
    return f"""{name}0 AS (SELECT *, {weights}::BIGINT AS w FROM {of}),
{name}1 AS (SELECT *, coalesce(sum(capacity) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, sum(w) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM {name}0),
{name}2 AS (SELECT *, (budget - c) * w >= capacity * r AS is_full FROM {name}1),
{name}3 AS (SELECT *, budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER (PARTITION BY {parent}), 0) AS remaining, CASE WHEN is_full THEN 0 ELSE w END AS open_w FROM {name}2),
{name}4 AS (SELECT *, sum(open_w) OVER (PARTITION BY {parent}) AS total_w, sum(open_w) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto_w FROM {name}3),
{name} AS (SELECT *, (CASE WHEN is_full THEN capacity ELSE (remaining * upto_w) // nullif(total_w, 0) - (remaining * (upto_w - open_w)) // nullif(total_w, 0) END)::BIGINT AS {out} FROM {name}4)"""


def _weights_sql(column: str, weights: dict[str, int]) -> str:
    return f"(CASE {' '.join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items())} ELSE {DEFAULT_WEIGHT} END)"


ORACLE = rf"""
WITH b AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS number FROM documents),
base AS (SELECT *, CASE WHEN number = '' THEN 'web' ELSE [{', '.join(f"'{d}'" for d in DOMAIN_WEIGHTS)}][(CASE WHEN number = '' THEN '0' ELSE number END)::INT % {len(DOMAIN_WEIGHTS)} + 1] END AS domain FROM b WHERE n > 0),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, sum(n)::BIGINT * {MAX_EPOCHS} AS capacity FROM base GROUP BY ALL),
lg AS (SELECT domain, lang, sum(capacity)::BIGINT AS capacity, sum(tokens)::BIGINT AS tokens FROM leaf GROUP BY ALL),
dm AS (SELECT domain, sum(capacity)::BIGINT AS capacity, sum(tokens)::BIGINT AS tokens FROM lg GROUP BY ALL),
dmb AS (SELECT *, 0 AS root, least(sum(tokens) OVER (), sum(capacity) OVER ())::BIGINT AS budget FROM dm),
{_fill_sql("d", "dmb", "root", "domain", _weights_sql("domain", DOMAIN_WEIGHTS), "domain_budget")},
lgb AS (SELECT lg.*, d.domain_budget AS budget FROM lg JOIN d ON lg.domain = d.domain),
{_fill_sql("l", "lgb", "domain", "lang", _weights_sql("lang", LANGUAGE_WEIGHTS), "lang_budget")},
leafb AS (SELECT leaf.*, l.lang_budget AS budget FROM leaf JOIN l ON leaf.domain = l.domain AND leaf.lang IS NOT DISTINCT FROM l.lang),
{_fill_sql("s", "leafb", "domain, lang", "source", "1", "leaf_budget")},
r AS (SELECT base.*, s.leaf_budget, s.leaf_budget // s.tokens AS whole, s.leaf_budget % s.tokens AS rest FROM base JOIN s ON base.domain = s.domain AND base.lang IS NOT DISTINCT FROM s.lang AND base.source IS NOT DISTINCT FROM s.source),
o AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')), doc_id NULLS FIRST, md5(t) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS ahead FROM r)
SELECT doc_id, domain, lang, source, n AS n_tokens, whole AS epoch, least(n, rest - ahead)::BIGINT AS taken, leaf_budget FROM o WHERE ahead < rest
UNION ALL
SELECT doc_id, domain, lang, source, n, unnest(range(whole)), n, leaf_budget FROM o WHERE whole > 0
"""
