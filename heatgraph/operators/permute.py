"""Permutations of heat and of mutations, seeded by hashes, and the statistics of permutation tests."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatgraph.plans.lineage import cut
from heatgraph.plans.ranks import numbered

#: Classes of mutation probabilities, each half of the one before.
MOST_CLASSES = 64
#: Draws that a task holds at once.
DRAWS = 200_000


def order_key(seed: int, *parts) -> Column:
    """A hash that orders, or with :func:`uniform` draws, independent of partitions and engines."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def uniform(seed: int, *parts) -> Column:
    """A number in [0, 1)."""
    return F.conv(F.substring(order_key(seed, *parts), 1, 8), 16, 10).cast("double") / 4294967296.0


def permuted_heat(heat: DataFrame, network: DataFrame, n: int, additional: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """``(perm_id, node, score)``: scores dealt over the eligible nodes, those of the network with heat or additional.

    Two ranks and an equi-join; a task holds one permutation, as large as the network.
    """
    nodes = heat.select("node") if additional is None else heat.select("node").union(additional.select("node"))
    eligible = nodes.distinct().join(network.select("node"), "node", "left_semi")
    scores = numbered(heat.join(network.select("node"), "node", "left_semi").select("node", "score"), "r", "node").select("score", F.col("r").cast("int").alias("r"))
    perms = heat.sparkSession.range(1, n + 1).withColumnRenamed("id", "perm_id")
    dealt = eligible.crossJoin(F.broadcast(perms))
    rank = F.row_number().over(Window.partitionBy("perm_id").orderBy(order_key(seed, "perm_id", "node")))
    return dealt.select("perm_id", "node", rank.alias("r")).join(scores, "r").select("perm_id", "node", "score")


def permuted_snvs(samples: DataFrame, genes: DataFrame, bmr: float, rates: DataFrame | None = None, perms: int = 1, seed: int = 42) -> DataFrame:
    """``(perm_id, sample, gene)``: each pair mutates with ``1 - (1 - bmr)^length``; the genes have ``length``."""
    table = genes if rates is None else genes.join(rates, "gene", "left")
    rate = F.lit(bmr) if rates is None else F.coalesce("bmr", F.lit(bmr))
    p = 1 - F.pow(1 - rate, F.col("length"))
    # x / 2**32 <= p, for the number x of the hash's first 8 digits, is digits that sort up to those of the whole part of p * 2**32; "g" is above any more
    most = F.when(p >= 1, F.lit("g")).when(p >= 0, F.concat(F.lpad(F.lower(F.hex(F.floor(p * 4294967296.0).cast("bigint"))), 8, "0"), F.lit("g")))
    ids = genes.sparkSession.range(1, perms + 1).withColumnRenamed("id", "perm_id")
    pairs = _spread_out(samples.select("sample")).crossJoin(F.broadcast(table.select("gene", most.alias("most")))).crossJoin(F.broadcast(ids))
    return pairs.where(order_key(seed, "perm_id", "sample", "gene") < F.col("most")).select("perm_id", "sample", "gene")


def _spread_out(samples: DataFrame) -> DataFrame:
    """Samples over all tasks: a table of few bytes is one task's, but there is much to be done for each of its rows."""
    return samples.repartition(4 * samples.sparkSession.sparkContext.defaultParallelism)


def _successes(n: int, p: float, rng: np.random.Generator) -> np.ndarray:
    """Those of ``n`` places, in order, that come up with probability ``p`` each: the gaps between them are drawn, so work is what comes out."""
    found, last = [], -1
    while last < n:
        want = (n - last) * p
        at = last + np.cumsum(rng.geometric(p, int(want + 4 * want**0.5) + 8))
        found.append(at)
        last = int(at[-1])
    at = np.concatenate(found)
    return at[: np.searchsorted(at, n)]


def _classes(genes: DataFrame, bmr: float, rates: DataFrame | None) -> DataFrame:
    """``(gene, p, class, at)``: genes ranked inside classes of mutation probabilities within a factor of two."""
    table = _probabilities(genes, bmr, rates).where("p > 0")
    table = table.withColumn("class", F.least(F.floor(-F.log2("p")), F.lit(MOST_CLASSES - 1)).cast("int"))
    return cut(table.withColumn("at", F.row_number().over(Window.partitionBy("class").orderBy("gene"))))


def _probabilities(genes: DataFrame, bmr: float, rates: DataFrame | None) -> DataFrame:
    """``(gene, p)``: with which a sample has the gene mutated."""
    table = genes if rates is None else genes.join(rates, "gene", "left")
    rate = F.lit(bmr) if rates is None else F.coalesce("bmr", F.lit(bmr))
    return table.select("gene", (1 - F.pow(1 - rate, F.col("length"))).alias("p"))


def sampled_snv_counts(samples: DataFrame, genes: DataFrame, bmr: float, rates: DataFrame | None = None, perms: int = 1, seed: int = 42) -> DataFrame:
    """``(perm_id, gene, n)``: in how many samples each gene is drawn by ``sampled_snvs``, the same draws, added up where they are made."""
    ranked = _classes(genes, bmr, rates)
    spark = ranked.sparkSession
    held = ranked.select("class", "at", "p").orderBy("class", "at").toPandas()
    shared = spark.sparkContext.broadcast({int(k): of["p"].to_numpy() for k, of in held.groupby("class")})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value
        counts = {(perm, k): np.zeros(len(p), np.int64) for perm in range(1, perms + 1) for k, p in of.items()}
        for rows in frames:
            for name in rows["name"]:
                for perm, k in counts:
                    rng = np.random.default_rng([seed, perm, zlib.crc32(name.encode()), k])
                    at = _successes(len(of[k]), 2.0**-k, rng)
                    counts[perm, k][at[rng.random(len(at)) * 2.0**-k < of[k][at]]] += 1
        for (perm, k), n in counts.items():
            yield pd.DataFrame({"perm_id": perm, "class": k, "at": np.arange(1, len(n) + 1), "n": n})

    names = _spread_out(samples.select("sample").distinct()).select(F.coalesce(F.col("sample").cast("string"), F.lit("")).alias("name"))
    found = names.mapInPandas(add, "perm_id bigint, class int, at int, n bigint").where("n > 0").groupBy("perm_id", "class", "at").agg(F.sum("n").alias("n"))
    return found.join(ranked, ["class", "at"]).select("perm_id", "gene", "n")


def sampled_snvs(samples: DataFrame, genes: DataFrame, bmr: float, rates: DataFrame | None = None, perms: int = 1, seed: int = 42) -> DataFrame:
    """``(perm_id, sample, gene)`` of the same distribution as ``permuted_snvs``, with work in proportion to what comes out.

    Genes are ranked inside classes of mutation probabilities within a factor of two. Each sample draws from each class how many of its genes
    would mutate at the class's largest probability, and which; a gene so drawn stays with its own share of that. No pair of
    sample and gene that isn't drawn is ever made; every draw depends on seed, permutation, sample and class only.
    """
    ranked = _classes(genes, bmr, rates)
    classes = ranked.groupBy("class").agg(F.count(F.lit(1)).alias("n"))  # at most MOST_CLASSES
    ids = genes.sparkSession.range(1, perms + 1).withColumnRenamed("id", "perm_id")
    kind = samples.schema["sample"].dataType.simpleString()

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            begin, held, out = 0, 0, []
            for i, (perm, name, k, n) in enumerate(rows[["perm_id", "name", "class", "n"]].itertuples(index=False)):
                rng = np.random.default_rng([seed, perm, zlib.crc32(name.encode()), k])
                at = _successes(n, 2.0**-k, rng) + 1
                out.append((at, rng.random(len(at))))
                held += len(at)
                if held >= DRAWS or i + 1 == len(rows):  # a frame of 10,000 samples would be as large as they draw from the whole table
                    of = begin + np.repeat(np.arange(len(out)), [len(at) for at, _ in out])
                    found = rows[["perm_id", "sample", "class"]].iloc[of].reset_index(drop=True)
                    yield found.assign(at=np.concatenate([at for at, _ in out]), u=np.concatenate([u for _, u in out]))
                    begin, held, out = i + 1, 0, []

    wanted = _spread_out(samples.select("sample").distinct()).crossJoin(F.broadcast(ids)).crossJoin(F.broadcast(classes)).withColumn("name", F.coalesce(F.col("sample").cast("string"), F.lit("")))
    drawn = wanted.mapInPandas(draw, f"perm_id bigint, sample {kind}, class int, at int, u double")
    return drawn.join(ranked, ["class", "at"]).where(F.col("u") * F.pow(F.lit(2.0), -F.col("class")) < F.col("p")).select("perm_id", "sample", "gene")


def cna_blocks(cnas: DataFrame, order: DataFrame) -> DataFrame:
    """``(sample, chromo, block, mut_type, start, n)``: runs of neighbouring genes with one kind of change.

    Gaps and islands inside each sample and chromosome, which bound what a task holds.
    """
    placed = cnas.select("sample", "gene", "mut_type").distinct().join(order.select("gene", "chromo", "pos"), "gene")
    window = Window.partitionBy("sample", "chromo").orderBy("pos", "mut_type")
    previous = placed.withColumns({"_p": F.lag("pos").over(window), "_m": F.lag("mut_type").over(window)})
    opens = F.when((F.col("_p") + 1 == F.col("pos")) & (F.col("_m") == F.col("mut_type")), 0).otherwise(1)
    running = previous.withColumn("block", F.sum(opens).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return running.groupBy("sample", "chromo", "block").agg(F.min("mut_type").alias("mut_type"), F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))


def _spread(sizes: list[int], length: int, rng: np.random.Generator) -> list[int]:
    """Starts of all blocks in random order, the free places dealt over the gaps: never fails if they fit apart."""
    spare = length - sum(sizes) - len(sizes) + 1
    gaps = np.sort(rng.integers(0, spare + 1, len(sizes)))
    starts, used = [0] * len(sizes), 0
    for gap, i in zip(gaps.tolist(), rng.permutation(len(sizes)).tolist()):
        starts[i] = gap + used
        used += sizes[i] + 1
    return starts


def permuted_blocks(blocks: DataFrame, order: DataFrame, perms: int = 1, seed: int = 42, attempts: int = 10, crowded: bool = False) -> DataFrame:
    """``(perm_id, sample, chromo, block, mut_type, start, n)``: blocks placed at random in their chromosome.

    Blocks neither overlap nor touch. After some failed attempts a place is chosen among all free ones;
    if there is none, all blocks of the chromosome are placed anew in random order with random gaps. If
    they don't fit apart at all, it is an error, or with ``crowded`` each is placed for itself, so that
    they may touch or overlap, as changes of two kinds do in samples themselves. No block is left out.
    """
    lengths = order.groupBy("chromo").agg((F.max("pos") - F.min("pos") + 1).alias("length"), F.min("pos").alias("origin"))
    ids = blocks.sparkSession.range(1, perms + 1).withColumnRenamed("id", "perm_id")
    table = blocks.join(F.broadcast(lengths), "chromo").crossJoin(F.broadcast(ids))
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    schema = f"perm_id bigint, sample {kinds['sample']}, chromo {kinds['chromo']}, block bigint, mut_type string, start bigint, n bigint"

    def placed(sizes: list[int], length: int, rng: np.random.Generator) -> list[int] | None:
        """One block after the other, or None if one finds no room."""
        n = np.array(sizes)
        if n.max() > length:
            return None
        drawn = (rng.random((len(n), attempts)) * (length - n + 1)[:, None]).astype(np.int64)
        by = np.argsort(drawn[:, 0], kind="stable")
        if (drawn[by[1:], 0] > drawn[by[:-1], 0] + n[by[:-1]]).all():  # all first attempts lie apart, as most do
            return drawn[:, 0].tolist()
        taken = np.zeros(length + 2, bool)  # shifted by one, with a border at each end
        starts = []
        for n, tries in zip(sizes, drawn.tolist()):
            room = length - n + 1
            fits = lambda s: not taken[s + 1 : s + 1 + n].any()  # noqa: E731,B023
            at = next((s for s in tries if fits(s)), None)
            if at is None:
                free = [s for s in range(room) if fits(s)]
                if not free:
                    return None
                at = int(rng.choice(free))
            taken[at : at + n + 2] = True
            starts.append(at)
        return starts

    def starts_of(perm: int, name: str, length: int, origin: int, sizes: list[int]) -> list[int]:
        rng = np.random.default_rng([seed, perm, zlib.crc32(name.encode())])
        starts = placed(sizes, length, rng)
        if starts is None and sum(sizes) + len(sizes) - 1 <= length:
            starts = _spread(sizes, length, rng)
        if starts is None:
            if not crowded or max(sizes) > length:
                raise RuntimeError("no room for a block")
            starts = [int(rng.integers(0, length - n + 1)) for n in sizes]
        return [at + origin for at in starts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups follow each other, many in a frame: a frame for each would take longer than its blocks do. The last may go on in the next frame."""
        held = None
        for rows in frames:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            codes = np.stack([pd.factorize(rows[c])[0] for c in ("perm_id", "sample", "chromo")])
            ends = np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1
            last = int(ends[-1]) if len(ends) else 0
            held = rows.iloc[last:]
            if last:
                yield whole(rows.iloc[:last], [0, *ends.tolist()])
        if held is not None and len(held):
            yield whole(held, [0, len(held)])

    def whole(rows: pd.DataFrame, ends: list[int]) -> pd.DataFrame:
        perm, name, length, origin, n = (rows[c].tolist() for c in ("perm_id", "name", "length", "origin", "n"))
        starts: list[int] = []
        for a, b in zip(ends, ends[1:]):
            starts += starts_of(perm[a], name[a], length[a], origin[a], n[a:b])
        return rows[["perm_id", "sample", "chromo", "block", "mut_type"]].assign(start=starts, n=n)

    keys = ["perm_id", "sample", "chromo"]
    table = table.withColumn("name", F.concat_ws("|", F.coalesce(F.col("sample").cast("string"), F.lit("None")), F.coalesce(F.col("chromo").cast("string"), F.lit("None"))))
    return table.repartition(*keys).sortWithinPartitions(*keys, "block").mapInPandas(run, schema)


def block_genes(blocks: DataFrame, order: DataFrame) -> DataFrame:
    """Placed blocks as mutations ``(perm_id, sample, gene, mut_type)``."""
    at = blocks.select("perm_id", "sample", "chromo", "mut_type", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"))
    return at.join(order.select("chromo", "pos", "gene"), ["chromo", "pos"]).select("perm_id", "sample", "gene", "mut_type")


def prevailing(cnas: DataFrame, threshold: float) -> DataFrame:
    """Of ``(perm_id, sample, gene, mut_type)`` those of the kind that a share ``threshold`` of the gene's changes has, in each permutation."""
    if not threshold > 0.5:
        raise ValueError("the threshold must be over 0.5")
    of = cnas.groupBy("perm_id", "gene").agg(F.count_if(F.col("mut_type") == "amp").alias("a"), F.count_if(F.col("mut_type") == "del").alias("d"))
    side = F.when(F.col("a") / (F.col("a") + F.col("d")) >= threshold, "amp").when(F.col("d") / (F.col("a") + F.col("d")) >= threshold, "del")
    return cnas.join(of.select("perm_id", "gene", side.alias("mut_type")), ["perm_id", "gene", "mut_type"], "left_semi").select("perm_id", "sample", "gene", "mut_type")


def permuted_mutation_heat(
    samples: DataFrame,
    genes: DataFrame,
    blocks: DataFrame,
    order: DataFrame,
    bmr: float,
    min_freq: int = 1,
    perms: int = 1,
    seed: int = 42,
    crowded: bool = False,
    rates: DataFrame | None = None,
    cna_threshold: float | None = None,
    network: DataFrame | None = None,
) -> DataFrame:
    """``(perm_id, node, score)``: mutation heat of permuted variants and blocks; untested genes are left out.

    Variants of a gene in each sample are independent draws of one probability, and heat only asks in how many samples there are any: those with a
    placed change and the others have binomial numbers of them, which are drawn as such, so no pair of sample and gene is made for them.

    ``rates`` ``(gene, bmr)`` go before the rate ``bmr``; with ``cna_threshold`` the placed changes are filtered
    as real ones are; with ``network`` ``(node)`` only its genes are tested.
    """
    if network is not None:
        genes = genes.join(network.select(F.col("node").alias("gene")).distinct(), "gene", "left_semi")
    changes = block_genes(permuted_blocks(blocks, order, perms, seed, crowded=crowded), order)
    if cna_threshold:
        changes = prevailing(changes, cna_threshold)
    people = samples.select("sample").distinct()
    n = people.count()
    changed = changes.join(genes.select("gene"), "gene", "left_semi").select("perm_id", "gene", "sample").distinct()
    tested = changed.join(people.withColumn("known", F.lit(1)), "sample", "left").groupBy("perm_id", "gene").agg(F.count(F.lit(1)).alias("c"), F.count("known").alias("known"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            s, both = np.zeros(len(rows), np.int64), rows["c"].to_numpy(np.int64, copy=True)
            for i, (perm, name, p, known) in enumerate(rows[["perm_id", "name", "p", "known"]].itertuples(index=False)):
                if p > 0:
                    rng = np.random.default_rng([seed, perm, zlib.crc32(name.encode())])
                    other = rng.binomial(n - known, min(p, 1.0))
                    s[i], both[i] = other + rng.binomial(known, min(p, 1.0)), both[i] + other
            yield rows[["perm_id", "node", "c"]].assign(s=s, both=both)

    ids = genes.sparkSession.range(1, perms + 1).withColumnRenamed("id", "perm_id")
    table = _probabilities(genes, bmr, rates).crossJoin(F.broadcast(ids)).join(tested, ["perm_id", "gene"], "left")
    kind = genes.schema["gene"].dataType.simpleString()
    table = table.select("perm_id", F.col("gene").alias("node"), F.coalesce(F.col("gene").cast("string"), F.lit("")).alias("name"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("known", F.lit(0)).alias("known"))
    table = table.mapInPandas(draw, f"perm_id bigint, node {kind}, c bigint, s bigint, both bigint")
    used = F.when(F.col("s") < min_freq, F.col("c")).otherwise(F.col("both"))
    return table.select("perm_id", "node", (used / F.lit(n)).alias("score"))


def statistics(real: DataFrame, permuted: DataFrame, n: int) -> DataFrame:
    """``(size, observed, expected, pval)`` of real ``(size, n)`` and permuted ``(perm_id, size, n)`` counts."""
    table = real.select("size", F.col("n").alias("observed")).join(permuted.select("size", "n"), "size", "left")
    grouped = table.groupBy("size", "observed").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(F.col("n") >= F.col("observed")).alias("as_many"))
    return grouped.select("size", "observed", (F.col("total") / n).alias("expected"), (F.col("as_many") / n).alias("pval"))
