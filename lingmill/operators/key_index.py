"""Deduplication of batches against what is published, by a persistent index of keys.

The index holds digests of keys, not texts: published shards are not read again. Its folder has a generation a batch:

    keys/generation=N/bucket=B/   digests, Parquet
    blooms/generation=N/          a Bloom filter for each bucket, Parquet
    commits/N                     a small file, renamed into place last, that names the batch and what N replaces

A generation without its commit isn't there; the next batch of that number writes over it. A batch's keys are looked up in the
filters of their buckets first, and only buckets with a key that may be there have their digests read. A batch that
runs again under its name sees the generations before it only, so it gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dedup_key
from ..session import cut, delete_folder, ship_package

HASHES = 7
BITS_A_KEY = 10


def digest(*parts: Column) -> Column:
    """16 bytes that tell tuples of strings apart; nulls are equal to nulls only."""
    return F.unhex(F.md5(F.to_json(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])).cast("binary")))


def bloom_places(digests: np.ndarray, size: int) -> np.ndarray:
    """Where a filter of `size` bits marks each digest (rows of two 64-bit numbers)."""
    a, b = digests[:, :1], digests[:, 1:] | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((a + np.arange(HASHES, dtype=np.uint64)[None, :] * b) % np.uint64(size)).astype(np.int64)


def _numbers(digests: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    size = max(64, BITS_A_KEY * len(pdf))
    bits = np.zeros(size, dtype=bool)
    bits[bloom_places(_numbers(pdf["digest"]), size).ravel()] = True
    return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "size": [size], "bits": [np.packbits(bits).tobytes()]})


def _probe(keys: pd.DataFrame, blooms: pd.DataFrame) -> pd.DataFrame:
    if not len(keys) or not len(blooms):
        return keys.iloc[:0][["digest", "bucket"]]
    own, may = _numbers(keys["digest"]), np.zeros(len(keys), dtype=bool)
    for size, raw in zip(blooms["size"], blooms["bits"]):
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8))
        may |= bits[bloom_places(own, int(size))].all(1)
    return keys.loc[may, ["digest", "bucket"]]


@dataclass(frozen=True)
class KeyIndex:
    """An index under a folder that all executors reach. A bucket's keys of one generation fit a task: choose `buckets` by the keys of a batch."""

    spark: SparkSession
    folder: str
    buckets: int = 64

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """(generation, name, replaces) of what is there, in order; generations that a later one replaces are left out."""
        path, fs = self._files()
        where = path(f"{self.folder}/commits")
        if not fs.exists(where):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(where) if not s.getPath().getName().startswith((".", "_")))
        found = []
        for name in names:
            stream = fs.open(path(f"{self.folder}/commits/{name}"))
            try:
                found.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
        gone = {g for c in found for g in c["replaces"]}
        return [c for c in found if c["generation"] not in gone]

    def _before(self, name: str) -> tuple[int, list[int], bool]:
        """The batch's generation, those before it, and whether it is committed."""
        there = self.commits()
        for c in there:
            if name in c["names"]:
                if len(c["names"]) > 1:
                    raise ValueError(f"batch {name} has been compacted with others")
                return c["generation"], [x["generation"] for x in there if x["generation"] < c["generation"]], True
        return 1 + max([0, *[c["generation"] for c in there]]), [c["generation"] for c in there], False

    def _read(self, kind: str, generations: list[int]) -> DataFrame:
        schema = "digest binary, generation int, bucket int" if kind == "keys" else "bucket int, size long, bits binary, generation int"
        r = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}")
        return r.parquet(*[f"{self.folder}/{kind}/generation={g}" for g in generations]).drop("generation")

    def dealt(self, keys: DataFrame) -> DataFrame:
        return keys.select("digest").distinct().withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int"))

    def may_hold(self, keys: DataFrame, name: str) -> DataFrame:
        """Of keys(digest), those that a filter of an earlier generation doesn't rule out: digest, bucket."""
        ship_package(self.spark)
        _, earlier, _ = self._before(name)
        own = self.dealt(keys)
        if not earlier:
            return own.limit(0)
        blooms = self._read("blooms", earlier)
        return own.groupBy("bucket").cogroup(blooms.groupBy("bucket")).applyInPandas(_probe, "digest binary, bucket int")

    def held(self, buckets: list[int], name: str) -> DataFrame:
        """The digests that earlier generations hold in these buckets; other buckets' files are not read."""
        _, earlier, _ = self._before(name)
        return self._read("keys", earlier).filter(F.col("bucket").isin(buckets)).select("digest")

    def seen(self, keys: DataFrame, name: str) -> DataFrame:
        """Of keys(digest), those that generations before the batch `name` hold."""
        may = cut(self.may_hold(keys, name))
        buckets = [r.bucket for r in may.select("bucket").distinct().collect()]  # at most self.buckets
        if not buckets:
            return may.select("digest")
        return may.select("digest").join(self.held(buckets, name), "digest", "left_semi")

    def add(self, keys: DataFrame, name: str) -> None:
        """keys(digest) as the batch `name`; nothing if that is committed. Only the commit makes them count."""
        generation, _, done = self._before(name)
        if done:
            return
        self._write(self.dealt(keys), generation, [name], [])

    def _write(self, dealt: DataFrame, generation: int, names: list[str], replaces: list[int]) -> None:
        ship_package(self.spark)
        where = f"{self.folder}/keys/generation={generation}"
        dealt.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "digest").write.mode("overwrite").partitionBy("bucket").parquet(where)
        written = self.spark.read.schema("digest binary, bucket int").parquet(where)
        written.groupBy("bucket").applyInPandas(_build, "bucket int, size long, bits binary").write.mode("overwrite").parquet(f"{self.folder}/blooms/generation={generation}")
        path, fs = self._files()
        fs.mkdirs(path(f"{self.folder}/commits"))
        own, target = path(f"{self.folder}/commits/.{generation:09d}"), path(f"{self.folder}/commits/{generation:09d}")
        stream = fs.create(own, True)
        try:
            stream.write(bytearray(json.dumps({"generation": generation, "names": names, "replaces": replaces}).encode()))
        finally:
            stream.close()
        if not fs.rename(own, target):
            raise RuntimeError(f"another writer has committed generation {generation}")

    def compact(self) -> None:
        """All generations as one, so that a lookup reads one filter a bucket. The old ones go once the new one is committed."""
        there = self.commits()
        if len(there) < 2:
            return
        old = [c["generation"] for c in there]
        self._write(self.dealt(self._read("keys", old)), 1 + max(old), [n for c in there for n in c["names"]], old)
        for g in old:
            for kind in ("keys", "blooms"):
                delete_folder(self.spark, f"{self.folder}/{kind}/generation={g}")


def dedup_batch(batch: DataFrame, folder: str, name: str, direction: str = "both", *, order: Sequence[str] = ("id",), buckets: int = 64) -> DataFrame:
    """The batch's pairs whose normalised source text (then, of the rest, target text) is new for the other side's language, both in the
    batch and against all batches before; its keys join the index under `name`.

    Batches that come in order give the rows that one run over all of them gives. order names the columns that tell rows apart and
    say which comes first. Texts are read for their keys and for the rows that stay; only digests and order columns are shuffled in between.
    A batch that runs again gives the same rows.
    """
    if direction not in ("source", "target", "both"):
        raise ValueError(f"no such direction: {direction}")
    sides = [s for s in (("source", "target"), ("target", "source")) if direction in (s[0], "both")]
    keys = {f"_{s}": digest(dedup_key(F.col(f"{s}_text")), F.col(f"{o}_nllb_code")) for s, o in sides}
    left = cut(batch.select(*order, *[c.alias(n) for n, c in keys.items()]))
    for side, _ in sides:
        own = f"_{side}"
        first = left.groupBy(own).agg(F.min(F.struct(*order, *[k for k in keys if k != own])).alias("_row")).select(own, "_row.*")
        index = KeyIndex(batch.sparkSession, f"{folder}/{side}", buckets)
        seen = index.seen(first.select(F.col(own).alias("digest")), name).withColumnRenamed("digest", own)
        left = cut(first.join(seen, own, "left_anti"))
        index.add(left.select(F.col(own).alias("digest")), name)
    return batch.join(left.select(*order), list(order), "left_semi")
