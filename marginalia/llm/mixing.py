"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's distinct texts are shuffled (by hash) into a stream, which may run through `max_repeats` times, and cut into
blocks of equally many tokens. Slots of the mix go to sources by the golden-ratio sequence mapped through the cumulative
weights; the n-th slot of a source takes its n-th block, so that every stretch of the mix holds the sources in their weights.

The size of the mix is the largest at which each source with texts can still hold its share within its repeats, or the
given total, for which sources that run out leave their rest to the others in proportion. Positions are prefix sums in
two levels, over buckets and within them: no source is sorted in one task. To the driver come sums per source only,
as many as mix_targets has rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.bpe import VOCABULARY, _slices, encoder, send
from marginalia.session import materialize, ready

BLOCK_TOKENS, BUCKET_TEXTS, SLOT_RUN = 4096, 10_000, 65_536
GOLDEN = (math.sqrt(5) - 1) / 2


def stock(docs: DataFrame, targets: DataFrame, key: str, text: str, source: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, source, n_tokens) of the distinct texts that have tokens in the target sources, written once.

    The same text under several keys, in one source or several, is one text under its least key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for part in _slices(batch, "text"):
                texts = part.column("text").to_pylist()
                digest = pa.array([xxhash.xxh128_digest(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("source"), digest, pa.array(enc.counts(texts), pa.int64())], names=["key", "source", "digest", "n_tokens"])

    ready()
    send(docs.sparkSession, vocabulary)
    kind = docs.schema[key].dataType.simpleString()
    some = docs.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("key"), source.alias("source"), F.col(text).alias("text"))
    some = some.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")  # mix_targets doesn't grow
    counted = some.select("key", "source", "text").mapInArrow(run, f"key {kind}, source string, digest binary, n_tokens long")
    return materialize(counted.where("n_tokens > 0").groupBy("digest").agg(F.min(F.struct("key", "source", "n_tokens")).alias("x")).select("x.*", F.xxhash64("digest").alias("order")), "stock")


def quotas(supply: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens of each source. Without total, the largest size at which all sources with texts keep their proportions."""
    cap = {s: supply.get(s, 0) * max(r, 0) for s, (_, r) in targets.items()}
    live = {s: w for s, (w, _) in targets.items() if w > 0 and cap[s] > 0}
    if not live:
        return {}
    whole = sum(live.values())
    if total is None:
        size = min(cap[s] / w for s, w in live.items()) * whole
        return {s: int(size * w / whole) for s, w in live.items()}
    out, rest, open_ = {}, float(total), dict(live)
    while open_:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if cap[s] <= rest * w / weight]
        if not full:
            out |= {s: int(rest * w / weight) for s, w in open_.items()}
            break
        for s in full:
            out[s] = cap[s]
            rest -= cap[s]
            open_.pop(s)
    return out


def _map(values: dict[str, float], kind: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for s, v in sorted(values.items()) for x in (s, v)]), F.col("source")).cast(kind)


def schedule(spark, wanted: dict[str, int], total_slots: int) -> DataFrame:
    """(source, nth, slot): the slots of each source in order. Slot i goes to the source in whose part of [0, 1) the
    fractional part of i times the golden ratio lies; a few slots more than needed make up for rounding."""
    names = sorted(wanted)
    whole = sum(wanted.values())
    edges = np.cumsum([wanted[s] / whole for s in names]).tolist()
    slots = int(total_slots * 1.01) + 64 * len(names)
    u = (F.col("id").cast("double") * F.lit(GOLDEN)) % F.lit(1.0)
    source = F.lit(names[-1])
    for s, e in reversed(list(zip(names[:-1], edges[:-1], strict=True))):
        source = F.when(u < e, F.lit(s)).otherwise(source)
    runs = spark.range(slots, numPartitions=max(1, min(1024, slots // SLOT_RUN + 1))).select(F.col("id").alias("slot"), source.alias("source"), F.floor(F.col("id") / SLOT_RUN).alias("run"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    start = runs.groupBy("source", "run").agg(F.count("*").alias("n")).select("source", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return runs.withColumn("at", F.row_number().over(Window.partitionBy("source", "run").orderBy("slot"))).join(start, ["source", "run"]).select("source", (F.col("base") + F.col("at") - 1).alias("nth"), "slot")


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: Column | None = None, total: int | None = None, block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY, stocked: DataFrame | None = None) -> DataFrame:
    """(slot, start, source, key, copy, n_tokens): the texts of the mix. Slots are in the order of the mix, start orders a
    source's texts; copy counts a text's appearances from 1 and stays within max_repeats.

    Null and empty texts and sources without a target take no part; a target without texts has no rows."""
    spark = docs.sparkSession
    have = stock(docs, targets, key, text, F.col("source") if source is None else source, vocabulary) if stocked is None else stocked
    goal = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.where("source is not null").collect()}
    sums = {r.source: (r.tokens, r.texts) for r in have.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts")).collect()}
    wanted = quotas({s: t for s, (t, _) in sums.items()}, goal, total)
    kind = docs.schema[key].dataType.simpleString()
    if not wanted:
        return spark.createDataFrame([], f"slot long, start long, source string, `{key}` {kind}, copy int, n_tokens long")
    buckets = {s: n // BUCKET_TEXTS + 1 for s, (_, n) in sums.items()}
    placed = have.where(F.col("source").isin(sorted(wanted))).withColumn("bucket", F.pmod("order", _map(buckets, "long")))
    within = Window.partitionBy("source", "bucket").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    stream = placed.withColumn("at", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(base, ["source", "bucket"]).withColumn("at", F.col("base") + F.col("at"))
    supply, quota = _map({s: float(t) for s, (t, _) in sums.items()}, "long"), _map({s: float(q) for s, q in wanted.items()}, "long")
    repeats = _map({s: float(r) for s, (_, r) in goal.items()}, "int")
    rounds = F.least(repeats, F.ceil(quota / supply).cast("int"))
    copies = stream.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))))).withColumn("start", (F.col("copy") - 1) * supply + F.col("at"))
    # a text stays if most of it lies within the quota
    copies = copies.where(F.col("start") + F.col("n_tokens") / 2 <= quota).withColumn("nth", F.floor(F.col("start") / block_tokens))
    blocks = {s: q // block_tokens + 1 for s, q in wanted.items()}
    slots = schedule(spark, wanted, sum(blocks.values()))
    # a block past its source's last slot goes to the end of the mix, so none is without a slot
    names = sorted(wanted)
    late = F.lit(1 << 40) + F.col("nth") * len(names) + _map({s: float(i) for i, s in enumerate(names)}, "long")
    return copies.join(slots, ["source", "nth"], "left").select(F.coalesce("slot", late).alias("slot"), "start", "source", F.col("key").alias(key), "copy", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame, stocked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(source, target_share, max_repeats, texts, tokens, mixed_rows, mixed_tokens, most_copies, share) of each target."""
    have = stocked.groupBy("source").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"))
    used = mixed.groupBy("source").agg(F.count("*").alias("mixed_rows"), F.sum("n_tokens").alias("mixed_tokens"), F.max("copy").alias("most_copies"))
    out = targets.join(have, "source", "left").join(used, "source", "left").na.fill(0, ["texts", "tokens", "mixed_rows", "mixed_tokens", "most_copies"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # as many rows as there are targets
    return out.withColumn("share", F.when(whole > 0, F.round(F.col("mixed_tokens") / whole, 6)).otherwise(F.lit(0.0)))
