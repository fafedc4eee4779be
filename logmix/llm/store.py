"""Sorted arrays as files in the shared folder, memory-mapped by the tasks that look things up in them.

A store is one file per shard of the key space. Tasks write a file under a fresh name and report it, so a task that runs
twice leaves a file that nobody reads. A folder on a local or mounted file system is mapped in place; from another one,
a worker fetches a file into its own scratch folder, maps it, and unlinks it at once.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmix.llm.batches import mix, pack, shard_bounds, shard_of, unpack
from logmix.storage import new_folder


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else "/" + folder.split(":/", 1)[1])


def write_arrays(folder: str, arrays: list[np.ndarray]) -> str:
    """Write arrays one after the other to a new file and return its name."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with system.open_output_stream(f"{path}/{name}") as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).tobytes())
    return name


def map_file(folder: str, name: str) -> np.ndarray:
    """The bytes of a file, memory-mapped."""
    system, path = _open(folder)
    if isinstance(system, fs.LocalFileSystem):
        local = f"{path}/{name}"
        return np.asarray(np.memmap(local, np.uint8, "r")) if os.path.getsize(local) else np.zeros(0, np.uint8)
    with tempfile.NamedTemporaryFile() as scratch, system.open_input_stream(f"{path}/{name}") as source:
        while block := source.read(1 << 20):
            scratch.write(block)
        scratch.flush()
        return np.asarray(np.memmap(scratch.name, np.uint8, "r")) if scratch.tell() else np.zeros(0, np.uint8)


def columns(raw: np.ndarray, dtypes: list[str]) -> list[np.ndarray]:
    """Cut a file of equally long arrays of the given kinds."""
    kinds = [np.dtype(x) for x in dtypes]
    n = len(raw) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        out.append(raw[at : at + n * kind.itemsize].view(kind))
        at += n * kind.itemsize
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of sorted ``wanted`` in sorted ``keys``; -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


_mapped: dict[tuple[str, str], list[np.ndarray]] = {}


class Store:
    """Shards of sorted scrambled keys with values beside them; the first array of each file holds the keys."""

    def __init__(self, folder: str, files: dict[int, str], shards: int, dtypes: list[str], sizes: dict[int, int] | None = None):
        self.folder, self.files, self.shards, self.dtypes = folder, files, shards, dtypes
        sizes = sizes or {}
        #: The place of each shard's first key among all keys.
        self.base = np.cumsum([0, *(sizes.get(k, 0) for k in range(shards))])

    def shard(self, k: int) -> list[np.ndarray]:
        if k not in self.files:
            return [np.zeros(0, d) for d in self.dtypes]
        place = (self.folder, self.files[k])
        if place not in _mapped:
            if len(_mapped) > 4096:
                _mapped.clear()
            _mapped[place] = columns(map_file(*place), self.dtypes)
        return _mapped[place]

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each sorted distinct key among all keys of the store; -1 where it is missing."""
        out = np.full(len(wanted), -1, np.int64)
        bounds = shard_bounds(wanted, self.shards)
        for k in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[k], bounds[k + 1]
            at = find(self.shard(int(k))[0], wanted[a:b])
            out[a:b] = np.where(at >= 0, at + self.base[k], -1)
        return out

    def at(self, places: np.ndarray, column: int) -> np.ndarray:
        """A column's values at sorted places."""
        out = np.zeros(len(places), self.dtypes[column])
        bounds = np.searchsorted(places, self.base)
        for k in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[k], bounds[k + 1]
            out[a:b] = self.shard(int(k))[column][places[a:b] - self.base[k]]
        return out

    def lookup(self, wanted: np.ndarray, missing: list) -> list[np.ndarray]:
        """For sorted distinct keys, the values beside each (all but the key array); ``missing`` where there is none."""
        out = [np.full(len(wanted), m, d) for m, d in zip(missing, self.dtypes[1:], strict=True)]
        if not len(wanted):
            return out
        bounds = shard_bounds(wanted, self.shards)
        for k in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[k], bounds[k + 1]
            keys, *values = self.shard(int(k))
            at = find(keys, wanted[a:b])
            hit = np.flatnonzero(at >= 0)
            for target, value in zip(out, values, strict=True):
                target[a + hit] = value[at[hit]]
        return out


def build(table: DataFrame, key: str, values: Sequence[str], label: str) -> Store:
    """A store of long columns: ``key`` scrambled, ``values`` beside it. Of rows with one key, one is kept."""
    spark = table.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, label)

    def send(batches):
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (key, *values)]
            keys = mix(columns[0].view(np.uint64))
            order = np.argsort(keys)
            bounds = shard_bounds(keys[order], shards)
            for k in np.flatnonzero(np.diff(bounds)):
                own = order[bounds[k] : bounds[k + 1]]
                blob = pack(keys[own], *(c[own].view(np.uint64) for c in columns[1:]))
                yield pa.record_batch([pa.array([k], pa.int64()), pa.array([blob], pa.binary())], ["shard", "blob"])

    def write(part: pa.Table) -> pa.Table:
        blobs = [unpack(b, 1 + len(values)) for b in part.column("blob").to_pylist()]
        keys, *rest = (np.concatenate(x) for x in zip(*blobs))
        order = np.argsort(keys, kind="stable")
        order = order[np.concatenate([[True], keys[order][1:] != keys[order][:-1]])]
        return pa.table({"shard": [part.column("shard")[0].as_py()], "file": [write_arrays(folder, [x[order] for x in (keys, *rest)])]})

    sent = table.select(key, *values).mapInArrow(send, "shard long, blob binary").repartition(shards, "shard")
    files = sent.groupBy("shard").applyInArrow(write, "shard long, file string").collect()  # one per shard
    return Store(folder, {r["shard"]: r["file"] for r in files}, shards, ["<u8"] + ["<i8"] * len(values))


class BlobStore:
    """Bytes by 64-bit key: places in a store of sorted scrambled keys, the bytes in a file beside each of its shards."""

    def __init__(self, index: Store, data: dict[int, str]):
        self.index, self.data = index, data

    def get_arrays(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of distinct keys end to end, in their order, and the size of each; -1 where there is none."""
        scrambled = mix(keys.view(np.uint64))
        order = np.argsort(scrambled)
        start, end = self.index.lookup(scrambled[order], [-1, -1])
        sizes = np.full(len(keys), -1, np.int64)
        sizes[order] = np.where(start < 0, -1, end - start)
        held = np.maximum(sizes, 0)
        bounds = np.concatenate([[0], np.cumsum(held)])
        out = np.zeros(bounds[-1], np.uint8)
        shards = shard_bounds(scrambled[order], self.index.shards)
        for k in np.flatnonzero(np.diff(shards)):
            found = np.arange(shards[k], shards[k + 1])
            found = found[start[found] >= 0]
            if len(found):
                place = (self.index.folder, self.data[int(k)])
                if place not in _mapped:
                    _mapped[place] = [map_file(*place)]
                own = held[order[found]]
                step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                out[np.repeat(bounds[order[found]], own) + step] = _mapped[place][0][np.repeat(start[found], own) + step]
        return out, sizes

    def get(self, keys: np.ndarray) -> list[bytes | None]:
        """The bytes of each key, which may repeat; None where there is none."""
        distinct, own = np.unique(keys, return_inverse=True)
        data, sizes = self.get_arrays(distinct)
        ends = np.cumsum(np.maximum(sizes, 0))
        found = [data[e - n : e].tobytes() if n >= 0 else None for e, n in zip(ends, sizes)]
        return [found[k] for k in own]


def _as_bytes(values: pa.Array) -> pa.Array:
    """Lists of 32-bit numbers as bytes; other arrays stay."""
    if not pa.types.is_list(values.type):
        return values
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(values).to_numpy(zero_copy_only=False))]) * 4
    raw = values.flatten().to_numpy(zero_copy_only=False).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)])


def build_blobs(table: DataFrame, key: str, value: str, label: str) -> BlobStore:
    """A store of a column of bytes, or of lists of 32-bit numbers, by a long key. Of rows with one key, one is kept."""
    spark = table.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, label)

    def place(batches):
        for batch in batches:
            keys = mix(batch.column(0).to_numpy().view(np.uint64))
            columns = [pa.array(shard_of(keys, shards)), batch.column(0), _as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "key", "value"])

    def write(part: pa.Table) -> pa.Table:
        keys, first = np.unique(mix(part.column("key").to_numpy().view(np.uint64)), return_index=True)
        values = part.column("value").take(pa.array(first)).to_pylist()
        ends = np.cumsum([len(v) for v in values])
        starts = np.concatenate([[0], ends[:-1]])
        index = write_arrays(folder, [keys, starts.astype("<i8"), ends.astype("<i8")])
        data = write_arrays(folder, [np.frombuffer(b"".join(values), np.uint8)])
        return pa.table({"shard": [part.column("shard")[0].as_py()], "index": [index], "data": [data]})

    rows = table.select(F.col(key).alias("key"), F.col(value).alias("value"))
    sent = rows.mapInArrow(place, "shard long, key long, value binary").repartition(shards, "shard")
    files = sent.groupBy("shard").applyInArrow(write, "shard long, index string, data string").collect()  # one per shard
    index = Store(folder, {r["shard"]: r["index"] for r in files}, shards, ["<u8", "<i8", "<i8"])
    return BlobStore(index, {r["shard"]: r["data"] for r in files})
