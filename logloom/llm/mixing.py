"""Mixing sources to target weights: exact block quotas, split among output shards by a hypergeometric tree.

1. ``targets``: sources get a share of the mix by weight; a source stops at ``most`` times its size and the excess goes to
   the others by weight, until none is above (solved in one pass over the sources in the order of cap per weight).
2. Every source is a stream: its documents in the order of a hash, the whole ``most`` times over. The stream is cut into
   blocks of ``block_words`` words and the blocks are permuted; the first of them, to the word, are the source's quota. So
   blocks are disjoint and no document is taken more than ``most`` times.
3. ``split``: the quotas, counted in blocks, go down a binary tree. At each node the left child gets half of the blocks, and
   how many of them come from each source is drawn from the multivariate hypergeometric distribution (source by source,
   by inversion of the exact probabilities). A leaf is an output shard; in a shard, blocks are ordered by a hash.

Only built-in functions. Running positions are two-level: sums per (source, hash bucket), then a window inside a bucket, so
a source with a third of all rows is spread over many tasks. Seeds fix every draw: reruns agree.

Null texts are empty; empty texts have size 0 and are never taken; a null source is a source of its own, after the others.
Repeated rows are rows of their own. Clashing column names do no harm: results are built from chosen columns only. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, with_columns_checked

#: Weights by the source's place, repeating; words of the mix per word of the input; repeats allowed.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
GAP = r"\x20\x09-\x0D"
#: A prime: taken modulo a number of blocks it is coprime to it, so multiplying permutes the blocks.
PRIME = 2147483647


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null is 0."""
    bare = F.ltrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(bare, f"[^{GAP}]++[{GAP}]*+", "x")).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          seed: int = 11, with_rows: bool = False) -> DataFrame:
    """(id, src, size, h): ``src`` marks null sources, ``h`` orders documents; ``row`` is the whole row, if asked for."""
    with_columns_checked(docs, id_col, text_col, source_col)
    return docs.select(
        F.col(id_col).alias("id"), F.when(F.col(source_col).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source_col))).alias("src"),
        word_count(F.col(text_col)).alias("size"), row_hash(docs, id_col, text_col, source_col, seed).alias("h"),
        *([F.struct(*docs.columns).alias("row")] if with_rows else []))


def row_hash(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int = 11) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col))


def targets(table: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: src, source_size, target (double)."""
    place = Window.orderBy(F.col("src") == "-", "src")
    every = Window.partitionBy()
    fill = Window.orderBy("cap_per_weight", F.col("src") == "-", "src")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1)
    s = (table.groupBy("src").agg(F.sum("size").alias("source_size")).withColumn("w", w)
         .withColumn("cap_per_weight", most * F.col("source_size") / F.col("w")))
    total = share * F.sum("source_size").over(every)
    capped = most * (F.sum("source_size").over(fill) - F.col("source_size"))
    open_w = F.sum("w").over(every) - F.sum("w").over(fill) + F.col("w")
    s = s.withColumn("level_here", (total - capped) / open_w)
    ok = F.when(F.col("cap_per_weight") >= F.col("level_here"), F.struct(
        "cap_per_weight", (F.col("src") == "-").alias("n"), "src", "level_here"))
    s = s.withColumn("level", F.min(ok).over(every)["level_here"])
    return s.select("src", "source_size", F.least(most * F.col("source_size").cast("double"), F.coalesce(
        F.col("level"), F.col("level_here")) * F.col("w")).alias("target"))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """Number of marked items among ``draws`` of ``population`` without replacement, for a uniform ``u``.

    Probabilities are summed from 12 standard deviations below the mode on, each from its neighbour; what lies outside
    weighs less than 1e-30.
    """
    n, k, d = (x.cast("double") for x in (population, marked, draws))

    def limits(p: Column) -> Column:
        reach = F.ceil(12 * F.sqrt(F.greatest(p["d"] * p["k"] * (p["n"] - p["k"]) * (p["n"] - p["d"]), F.lit(0.0))
                                   / F.greatest(p["n"] * p["n"] * (p["n"] - 1), F.lit(1.0)))) + 12
        mode = F.floor((p["d"] + 1) * (p["k"] + 1) / (p["n"] + 2))
        return bind(F.struct(mode.alias("mode"), reach.alias("reach")), lambda m: F.struct(
            p["n"].alias("n"), p["k"].alias("k"), p["d"].alias("d"), p["u"].alias("u"),
            F.greatest(F.lit(0.0), p["d"] - p["n"] + p["k"], m["mode"] - m["reach"]).cast("long").alias("lo"),
            F.least(p["d"], p["k"], m["mode"] + m["reach"]).cast("long").alias("hi")))

    def choose(p: Column) -> Column:
        ratio = lambda x: (p["k"] - x) * (p["d"] - x) / ((x + 1) * (p["n"] - p["k"] - p["d"] + x + 1))
        steps = F.when(p["hi"] > p["lo"], F.sequence(p["lo"], p["hi"] - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
        total = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum")), lambda a, x: bind(
            a["w"] * ratio(x), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"))), lambda a: a["sum"])
        start = F.struct(p["lo"].alias("at"), F.lit(1.0).alias("w"), F.lit(1.0).alias("below"))
        # walk up while the probability summed so far does not reach u
        return bind(p["u"] * total, lambda goal: F.aggregate(steps, start, lambda a, x: F.when(a["below"] < goal, bind(
            a["w"] * ratio(x), lambda w: F.struct((x + 1).alias("at"), w.alias("w"), (a["below"] + w).alias("below")))
        ).otherwise(a), lambda a: a["at"]))

    return bind(bind(F.struct(n.alias("n"), k.alias("k"), d.alias("d"), u.alias("u")), limits), choose)


def split(quotas: DataFrame, scratch: Scratch, shards: int = 16, seed: int = 11) -> DataFrame:
    """(src, blocks) to (src, bounds): shard i of ``shards`` (a power of two) has the source's ranks bounds[i] to bounds[i+1].

    One row per tree node holds the quotas of all sources at that node: as many numbers as there are sources.
    """
    levels = shards.bit_length() - 1
    if shards != 1 << levels:
        raise ValueError("the number of shards is a power of two")
    item = "array<struct<src:string,q:bigint>>"
    nodes = quotas.groupBy(F.lit(0).alias("node")).agg(F.array_sort(F.collect_list(F.struct(
        "src", F.col("blocks").cast("long").alias("q")))).cast(item).alias("items"))
    for level in range(levels):
        total = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["q"])
        zero = F.struct(total.alias("left"), F.ceil(total / 2).cast("long").alias("draws"),
                        F.expr("cast(array() as array<bigint>)").alias("out"))
        lvl = F.lit(level)

        def draw(a: Column, x: Column) -> Column:
            u = (F.pmod(F.xxhash64(F.lit(seed), lvl, F.col("node"), x["src"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
            return bind(hypergeometric(a["left"], x["q"], a["draws"], u), lambda v: F.struct(
                (a["left"] - x["q"]).alias("left"), (a["draws"] - v).alias("draws"), F.concat(a["out"], F.array(v)).alias("out")))

        nodes = nodes.withColumn("taken", F.aggregate("items", zero, draw, lambda a: a["out"]))
        child = lambda side, f: F.struct((F.col("node") * 2 + side).alias("node"), F.zip_with(
            "items", "taken", lambda x, t: F.struct(x["src"].alias("src"), f(x["q"], t).alias("q"))).cast(item).alias("items"))
        nodes = nodes.select(F.inline(F.array(child(0, lambda q, t: t), child(1, lambda q, t: q - t))))
        nodes = scratch.write(nodes, "nodes")
    leaves = nodes.select("node", F.inline("items"))
    ordered = leaves.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("node", "q"))).alias("leaves"))
    bounds = F.aggregate(F.col("leaves"), F.array(F.lit(0).cast("long")), lambda a, x: F.concat(
        a, F.array(F.element_at(a, -1) + x["q"])))
    return ordered.select("src", bounds.alias("bounds"))


def mix(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block_words: int = 1024, shards: int = 16, rows_per_bucket: int = 4096, seed: int = 11, with_rows: bool = False,
        **shares) -> DataFrame:
    """One row per row of ``docs``: id, src, h, size, source_size, target and ``draws``.

    ``draws`` is an array of (epoch, block, shard, ord, a, b, word): words a to b of the document are taken, as part of that
    block, into that shard, where blocks stand in the order of ``ord`` and a block's words in the order of ``word``. With
    ``with_rows`` there are also ``row``, the row of ``docs``, and ``all_blocks``, the number of blocks of all sources.
    """
    table = scratch.write(sized(docs, id_col, text_col, source_col, seed), "sizes")
    n = table.count()
    bits = max(4, (n // rows_per_bucket).bit_length())
    bucket = F.shiftright("h", 64 - bits)
    src = targets(table, **shares)
    most = shares.get("most", MOST)
    length = F.col("source_size") * most
    src = (src.withColumn("quota", F.least(F.round("target").cast("long"), length))
           .withColumn("n_blocks", F.ceil(length / block_words).cast("long"))
           .withColumn("mult", F.pmod(F.lit(PRIME).cast("long"), F.greatest("n_blocks", F.lit(1).cast("long"))))
           .withColumn("shift", F.pmod(F.xxhash64(F.lit(seed), "src"), F.greatest("n_blocks", F.lit(1).cast("long"))))
           .withColumn("short", F.col("n_blocks") * block_words - length))
    rank_of = lambda b: F.pmod(b * F.col("mult") + F.col("shift"), F.greatest("n_blocks", F.lit(1).cast("long")))
    src = src.withColumn("all_blocks", F.sum("n_blocks").over(Window.partitionBy()))
    src = scratch.write(src.withColumn("short_rank", rank_of(F.col("n_blocks") - 1)), "sources")
    blocks = src.select("src", F.least(F.col("n_blocks"), F.ceil((F.col("quota") + F.col("short")) / block_words)).cast("long").alias("blocks"))
    src = scratch.write(src.join(split(blocks, scratch, shards, seed), "src"), "shards")

    table = table.withColumn("bucket", bucket)
    rows = sized(docs, id_col, text_col, source_col, seed, True).withColumn("bucket", bucket) if with_rows else table
    carried = ["row"] if with_rows else []
    before = Window.partitionBy("src").orderBy("bucket")
    sums = (table.groupBy("src", "bucket").agg(F.sum("size").alias("s"))
            .select(F.col("src").alias("s_src"), F.col("bucket").alias("s_bucket"), (F.sum("s").over(before) - F.col("s")).alias("base")))
    inside = Window.partitionBy("src", "bucket").orderBy("h", "size", *(F.xxhash64(c) for c in carried)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows.join(sums, (F.col("src") == F.col("s_src")) & (F.col("bucket") == F.col("s_bucket")))
              .withColumn("at", F.col("base") + F.sum("size").over(inside) - F.col("size"))
              .select("id", "src", "h", "size", "at", *carried))
    joined = placed.join(src, "src", "left")

    def epoch(e: int) -> Column:
        first = F.col("at") + F.lit(e) * F.col("source_size")
        last = first + F.col("size")

        def piece(b: Column) -> Column:
            rank = rank_of(b)
            start = rank * block_words - F.when(rank > F.col("short_rank"), F.col("short")).otherwise(F.lit(0))
            u = F.greatest(first, b * block_words)
            v = F.least(last, (b + 1) * block_words, F.col("quota") - start + b * block_words)
            shard = F.size(F.filter("bounds", lambda x: x <= rank)) - 1
            return F.struct(F.lit(e).alias("epoch"), b.alias("block"), F.least(shard, F.lit(shards - 1)).alias("shard"),
                            F.xxhash64(F.lit(seed + 1), F.col("src"), b).alias("ord"), (u - first).alias("a"), (v - first).alias("b"),
                            u.alias("word"))

        some = F.sequence(F.floor(first / block_words), F.floor((last - 1) / block_words))
        return F.filter(F.transform(some, piece), lambda x: x["b"] > x["a"])

    draws = F.when(F.col("size") > 0, F.concat(*(epoch(e) for e in range(most)))).otherwise(F.expr(
        "cast(array() as array<struct<epoch:int,block:bigint,shard:int,ord:bigint,a:bigint,b:bigint,word:bigint>>)"))
    return joined.select(F.col("id").alias(id_col), "src", "h", "size", "source_size", "target", draws.alias("draws"),
                         *(["row", "all_blocks"] if with_rows else []))


def taken(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Words taken of each document."""
    return mixed.select(id_col, "size", "source_size", "target", F.aggregate(
        "draws", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"]).alias("taken"))


def mixture(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            shards: int = 16, blocks_per_part: int = 256, seed: int = 11, **options) -> DataFrame:
    """The mix as rows of ``docs``: a row per document and block with the words taken, shard by shard.

    A shard is cut by ``ord`` into parts of about ``blocks_per_part`` blocks, and a part's rows lie together in the order of its
    blocks, so the draws decide where and in which order words stand. White space after a taken word stays. The
    column ``n_chars``, where there is one, is the length of the new text. Repeated rows have a plan each.
    """
    mixed = mix(docs, scratch, id_col, text_col, source_col, shards=shards, seed=seed, with_rows=True, **options)
    shard, order, word, part = (free_name(docs, x) for x in ("shard", "ord", "word", "part"))
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(f"[^{GAP}]++[{GAP}]*+"), F.lit(0))
    parts = F.ceil(F.col("all_blocks") / (shards * blocks_per_part))
    cut = bind(words, lambda ws: F.transform("draws", lambda x: F.struct(
        x["shard"].alias("shard"), x["ord"].alias("ord"), x["word"].alias("word"),
        F.floor((x["ord"] / float(1 << 64) + 0.5) * parts).alias("part"),
        F.array_join(F.slice(ws, x["a"].cast("int") + 1, (x["b"] - x["a"]).cast("int")), "").alias("text"))))
    got = mixed.where(F.size("draws") > 0).select("row", F.explode(cut).alias("piece"))
    got = got.select(*((F.col("piece")["text"] if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns), *(
        F.col("piece")[x].alias(y) for x, y in (("shard", shard), ("ord", order), ("word", word), ("part", part))))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return got.repartition(shard, part).sortWithinPartitions(shard, order, word).select(*docs.columns)
