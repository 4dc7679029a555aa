"""Market basket analysis.

* ``item_support``     – share of invoices containing each item.
* ``basket_pairs``     – support / confidence / lift for pairs of the top
  items.  Lines of other items are left out before the shuffle, each invoice
  is reduced to the ranks of the top items it holds (at most ``top_n``), and
  pairs are counted per distinct combination, never per invoice.
* ``frequent_itemsets``– itemsets of every length from vertical bitmaps: which
  invoices of a block hold an item, intersected level by level.
* ``association_rules``– every antecedent/consequent split of every
  frequent itemset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll import functions as tf
from tillroll.operators.cleaning import identified_customers
from tillroll.operators.scalars import attach_one_row
from tillroll.plans.materialize import cut, drop_cut, partitions_for


def _shl(x, n):
    """x << n with a column shift amount."""
    return F.call_function("shiftleft", x, n)


def _shr(x, n):
    return F.call_function("shiftright", x, n)


def invoice_items(df: DataFrame, item_col: str = "Description") -> DataFrame:
    """A20 + P38: distinct (InvoiceNo, item) bought with positive quantity."""
    return (df.where(F.col(item_col).isNotNull() & F.col("InvoiceNo").isNotNull())
              .groupBy("InvoiceNo", F.col(item_col).alias("item"))
              .agg(F.sum("Quantity").alias("_q"))
              .where(F.col("_q") > 0)
              .select("InvoiceNo", "item"))


def _invoice_count(df: DataFrame, item_col: str) -> DataFrame:
    """Invoices of the basket table (rows of the invoice x item matrix)."""
    return (df.where(F.col(item_col).isNotNull() & F.col("InvoiceNo").isNotNull())
              .agg(F.count_distinct("InvoiceNo").alias("_n")))


def item_support(df: DataFrame, item_col: str = "Description", min_support: float = 0.01) -> DataFrame:
    """A21 + F11: items with support >= min_support, most supported first.
    Columns: item, invoices, support, rank (1 = most supported)."""
    counts = invoice_items(df, item_col).groupBy("item").agg(F.count(F.lit(1)).alias("invoices"))
    s = (attach_one_row(counts, _invoice_count(df, item_col))
               .withColumn("support", F.col("invoices") / F.col("_n"))
               .where(F.col("support") >= min_support))
    return s.select("item", "invoices", "support").orderBy(F.desc("support"), "item")


def basket_pairs(df: DataFrame, item_col: str = "Description", top_n: int = 20,
                 min_item_support: float = 0.01, min_lift: float = 1.2,
                 min_pair_support: float = 0.005, label_len: int = 30) -> DataFrame:
    """A22 + J4 + F12: pairs (A, B) of the ``top_n`` most supported items
    (A the more supported), with Support_AB, Confidence_A_to_B,
    Confidence_B_to_A and Lift; kept when lift > min_lift and
    support >= min_pair_support; lift descending."""
    items = invoice_items(df, item_col)
    counts = items.groupBy("item").agg(F.count(F.lit(1)).alias("cnt"))
    # The top items (at most top_n rows) and the invoice count are computed
    # once by a small job and broadcast as a local table, so the pair plan
    # does not re-derive them for each use.
    spark = df.sparkSession
    n = _invoice_count(df, item_col).first()[0] or 0
    ranked = (counts.withColumn("support", F.col("cnt") / F.lit(n) if n else F.lit(None).cast("double"))
                    .where(F.col("support") >= min_item_support)
                    .orderBy(F.desc("support"), "item").limit(top_n).collect())
    top = F.broadcast(spark.createDataFrame(
        [(r["item"], r["support"], i, n) for i, r in enumerate(ranked)],
        "item string, support double, rk int, _n bigint"))
    top_b = top.select("item", "rk")
    held = invoice_items(df.join(top_b.select(F.col("item").alias(item_col)), item_col, "left_semi"), item_col)
    combos = (held.join(top_b, "item")
                  .groupBy("InvoiceNo").agg(F.array_sort(F.collect_list("rk")).alias("rks"))
                  .groupBy("rks").agg(F.count(F.lit(1)).alias("invoices")))
    # Pairs per distinct combination (at most top_n*(top_n-1)/2 each).
    pairs = F.expr("flatten(transform(rks, (a, i) -> transform(slice(rks, i + 2, size(rks)), b -> struct(a AS a, b AS b))))")
    pair_counts = (combos.select(F.explode(pairs).alias("p"), "invoices")
                         .groupBy(F.col("p.a").alias("ra"), F.col("p.b").alias("rb"))
                         .agg(F.sum("invoices").alias("cnt_ab")))
    ta = top.select(F.col("rk").alias("ra"), F.col("item").alias("item_a"),
                    F.col("support").alias("support_a"), "_n")
    tb = top.select(F.col("rk").alias("rb"), F.col("item").alias("item_b"),
                    F.col("support").alias("support_b"))
    j = pair_counts.join(ta, "ra").join(tb, "rb")
    s_ab = F.col("cnt_ab") / F.col("_n")
    out = j.select(
        tf.truncate_label("item_a", label_len, ellipsis=False).alias("Item_A"),
        tf.truncate_label("item_b", label_len, ellipsis=False).alias("Item_B"),
        s_ab.alias("Support_AB"),
        (s_ab / F.col("support_a")).alias("Confidence_A_to_B"),
        (s_ab / F.col("support_b")).alias("Confidence_B_to_A"),
        (s_ab / (F.col("support_a") * F.col("support_b"))).alias("Lift"))
    return (out.where((F.col("Lift") > min_lift) & (F.col("Support_AB") >= min_pair_support))
               .orderBy(F.desc("Lift"), "Item_A", "Item_B"))


def transactions(df: DataFrame, item_col: str = "Description", identified_only: bool = True,
                 min_support: float = 0.0) -> DataFrame:
    """One row per invoice with its distinct items (sorted array).  Items
    below ``min_support`` are left out of the arrays (an invoice without any
    other keeps an empty one), so that an array holds at most 1/min_support
    times the mean basket, however many lines an invoice has."""
    base = identified_customers(df) if identified_only else df
    bought = (base.where(F.col(item_col).isNotNull() & F.col("InvoiceNo").isNotNull())
                  .select("InvoiceNo", F.col(item_col).alias("item")).distinct())
    if min_support > 0:
        bought = cut(bought, "basket-items")
        invoices = bought.agg(F.count_distinct("InvoiceNo").alias("_n"))
        counts = attach_one_row(bought.groupBy("item").agg(F.count(F.lit(1)).alias("_c")), invoices)
        kept = counts.where(F.col("_c") / F.col("_n") >= min_support).select("item", F.lit(True).alias("_kept"))
        bought = bought.join(kept, "item", "left")
        item = F.when(F.col("_kept"), F.col("item"))
    else:
        item = F.col("item")
    return bought.groupBy("InvoiceNo").agg(F.array_sort(F.collect_list(item)).alias("items"))


BLOCK_INVOICES = 8192


def item_bitmaps(tx: DataFrame, invoices: int) -> DataFrame:
    """``block, prefix, last, words``: of a block of about ``BLOCK_INVOICES``
    invoices and an item, one bit per invoice that holds it, 64 to a word.
    Blocks are cut by a hash of the invoice, so an item that a third of all
    invoices hold is spread over all blocks, at one bitmap each."""
    w = Window.partitionBy("block")
    placed = (tx.select(F.pmod(F.xxhash64("InvoiceNo"), F.lit(1 + invoices // BLOCK_INVOICES)).alias("block"), "InvoiceNo", "items")
                .withColumn("bit", F.row_number().over(w.orderBy("InvoiceNo")) - 1)
                .withColumn("size", F.count(F.lit(1)).over(w))
                .select("block", "size", "bit", F.explode("items").alias("last")))
    word = _shr(F.col("bit"), F.lit(6)).alias("word")
    bits = F.expr("bit_or(shiftleft(1L, bit & 63))").alias("bits")
    held = placed.groupBy("block", "size", "last", word).agg(bits)
    of_item = held.groupBy("block", "size", "last").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    words = F.expr("transform(sequence(0, (size - 1) div 64), i -> coalesce(try_element_at(m, cast(i AS INT)), 0L))")
    return of_item.select("block", F.array().cast("array<string>").alias("prefix"), "last", words.alias("words"))


_ONES = "aggregate(words, 0L, (n, w) -> n + bit_count(w))"


def _extended(covers: DataFrame) -> DataFrame:
    """Sets of one item more (``prefix`` and ``last``) and their bitmaps per
    block, from two sets that differ in their last item."""
    a, b = covers.alias("a"), covers.alias("b")
    both = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.prefix") == F.col("b.prefix")) & (F.col("a.last") < F.col("b.last")))
    return both.select(F.col("a.block").alias("block"), F.concat("a.prefix", F.array("a.last")).alias("prefix"), F.col("b.last").alias("last"),
                       F.expr("zip_with(a.words, b.words, (x, y) -> x & y)").alias("words"))


def frequent_itemsets(df: DataFrame, item_col: str = "Description", min_support: float = 0.01,
                      identified_only: bool = True) -> DataFrame:
    """All itemsets with support >= min_support.  Columns: items (sorted
    array), itemset (comma text), length, freq, support.

    A level counts the sets that two frequent ones make, block by block, and
    then keeps the bitmaps of the frequent ones for the next.  A block holds at
    most mean basket / min_support items.  The sets are written once, as rules
    read them three times.  Every move has as many pieces as the lines need."""
    with partitions_for(df.sparkSession, df.count()):
        return _frequent_itemsets(df, item_col, min_support, identified_only)


def _frequent_itemsets(df: DataFrame, item_col: str, min_support: float, identified_only: bool) -> DataFrame:
    tx = cut(transactions(df, item_col, identified_only, min_support), "transactions")
    n = tx.count()
    supported = lambda sets: sets.where(F.col("freq") / F.lit(n) >= min_support) if n else sets
    counted = lambda covers: supported(covers.groupBy("prefix", "last").agg(F.sum(F.expr(_ONES)).alias("freq")))
    covers = cut(item_bitmaps(tx, n), "item-bitmaps")
    levels = [cut(counted(covers), "itemset-level")]
    while levels[-1].limit(2).count() == 2:
        levels.append(cut(counted(_extended(covers)), "itemset-level"))
        deeper = cut(_extended(covers).join(levels[-1].select("prefix", "last"), ["prefix", "last"], "left_semi")
                     .select("block", "prefix", "last", "words"), "itemset-bitmaps")
        drop_cut(covers)
        covers = deeper
    sets = reduce(DataFrame.unionByName, levels).select(F.concat("prefix", F.array("last")).alias("items"), "freq")
    out = cut(sets.select("items", F.array_join("items", ", ").alias("itemset"), F.size("items").alias("length"), "freq",
                          (F.col("freq") / F.lit(n) if n else F.lit(None).cast("double")).alias("support")), "itemsets")
    for table in (tx, covers, *levels):
        drop_cut(table)
    return out


def association_rules(itemsets: DataFrame, metric: str = "lift", min_threshold: float = 0.5) -> DataFrame:
    """A45 + F13 + P34: for each frequent itemset of length k >= 2 every split
    into a non-empty antecedent and consequent (2^k - 2 rules), with
    antecedent/consequent support, support, confidence, lift, leverage and
    conviction (null when confidence is 1); kept where metric >= threshold;
    lift descending."""
    # All splits of a set of k items as bit masks, made in two steps so that no
    # row ever holds an array of more than 2**16 of them.
    one = F.lit(1).cast("bigint")
    low = F.least("length", F.lit(16))
    multi = (itemsets.where(F.col("length") >= 2).select("items", "support", "length")
             .withColumn("_hi", F.explode(F.sequence(F.lit(0).cast("bigint"), _shl(one, F.col("length") - low) - 1)))
             .withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("bigint"), _shl(one, low) - 1))))
    masks = (multi.withColumn("mask", _shl(F.col("_hi"), low).bitwiseOR(F.col("_lo")))
             .where((F.col("mask") > 0) & (F.col("mask") < _shl(one, F.col("length")) - 1)))
    in_mask = lambda i: _shr(F.col("mask"), i).bitwiseAND(F.lit(1)) == 1
    split = masks.select(
        F.filter("items", lambda x, i: in_mask(i)).alias("ante"),
        F.filter("items", lambda x, i: ~in_mask(i)).alias("cons"),
        "support")
    sup = itemsets.select(F.col("items").alias("_k"), F.col("support").alias("_s"))
    j = (split.join(sup.withColumnsRenamed({"_k": "ante", "_s": "antecedent_support"}), "ante")
              .join(sup.withColumnsRenamed({"_k": "cons", "_s": "consequent_support"}), "cons"))
    conf = F.col("support") / F.col("antecedent_support")
    rules = j.select(
        F.array_join("ante", ", ").alias("antecedents"),
        F.array_join("cons", ", ").alias("consequents"),
        "antecedent_support", "consequent_support", "support",
        conf.alias("confidence"),
        (conf / F.col("consequent_support")).alias("lift"),
        (F.col("support") - F.col("antecedent_support") * F.col("consequent_support")).alias("leverage"),
        F.when(conf < 1, (1 - F.col("consequent_support")) / (1 - conf)).alias("conviction"))
    return (rules.where(F.col(metric) >= min_threshold)
                 .orderBy(F.desc("lift"), "antecedents", "consequents"))
