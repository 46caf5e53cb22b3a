"""Product codes of vectors by Lloyd's rounds with heaps.

Each vector is cut into equal consecutive parts, and each part position has its own codebook. Rows lie in blocks that no
shuffle moves. For every part position and entry a block keeps a heap of the parts assigned to that entry, keyed by how much
slack they had when they were last compared: the distance to the second nearest entry (lower bound of all others) less that to
their own (upper bound), plus what the entry had drifted until then. After entries move, a part can only change hands once its
entry's drift since then (its own move and the largest move of another one, added up round by round) has used that slack
up. So a round pops each heap down to the drift and compares just these parts with all entries, exactly, in integers; the others
aren't looked at. The heaps are sorted runs: popping takes a prefix, pushing merges what came. Bounds are doubles made safe by
a margin, and equal distances leave no slack, so rounding never decides.

What moved changes its entries' sums; blocks report these changes, tasks add them up, and the driver gets one number for each
part position, entry and component. Each round writes blocks and heaps to the shared folder and drops the round before, so a
lost executor rereads files.

Nulls: a row without vector, or with a null or non-finite component, is dropped; a null key stays and sorts last, a null label is
a label. Vectors shorter than the longest (rounded up to a multiple of the parts) count as continued with zeros. Ties go to
the lower entry; rows that repeat are rows. With fewer rows than entries the codebooks are shorter; an empty table gives no rows.
Other columns, whatever their names, are ignored. Components so large that a vector's squared distance can't be a long are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import Table

#: Vectors in a block; the salts that a label's rows are dealt over.
BLOCK, SALTS = 8192, 256
STATE = "data binary, heap binary, keys binary, sizes array<int>, changes array<long>"


def kept_rows(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v) of the rows whose vector is whole and finite."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), v.alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column, rows continued with zeros."""
    offsets, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    x = np.floor(flat * float(scale))
    if 4 * float(np.abs(x).max(initial=0)) ** 2 * width >= 2.0**62:
        raise OverflowError(f"squared distances of components scaled by {scale} exceed a long")
    if len(offsets) and (offsets == width).all():
        return x.astype(np.int64).reshape(-1, width)
    out = np.zeros((len(offsets), width), np.int64)
    out[np.arange(width) < offsets[:, None]] = x
    return out


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, (n, d) against (k, d)."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < 1 << 53:  # all sums below are whole doubles
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def compared(x: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part and its key in that entry's heap, as single floats rounded down."""
    d = squared(x, entries)
    own = d.argmin(1)
    rows = np.arange(len(d))
    upper = np.sqrt(d[rows, own].astype(np.float64))
    if len(entries) > 1:
        d[rows, own] = np.iinfo(np.int64).max
        lower = np.sqrt(d.min(1).astype(np.float64))
    else:
        lower = np.full(len(d), np.inf)
    key = (lower - upper) - 1e-12 * (lower + upper) + drift[own] if len(entries) > 1 else lower
    single = key.astype(np.float32)
    return own, np.where(single > key, np.nextafter(single, np.float32(-np.inf)), single)


class Heaps:
    """One part position of a block: for each entry the parts assigned to it, by key."""

    def __init__(self, members: list[np.ndarray], keys: list[np.ndarray]):
        self.members, self.keys = members, keys

    @classmethod
    def empty(cls, entries: int) -> Heaps:
        return cls([np.zeros(0, np.int16)] * entries, [np.zeros(0, np.float32)] * entries)

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts whose slack the drift has used up, with the entry they leave."""
        found, left = [], []
        for e, keys in enumerate(self.keys):
            n = int(np.searchsorted(keys, drift[e], side="right"))
            if n:
                found.append(self.members[e][:n])
                left.append(np.full(n, e))
                self.members[e], self.keys[e] = self.members[e][n:], keys[n:]
        return (np.concatenate(found).astype(np.int64), np.concatenate(left)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def push(self, parts: np.ndarray, own: np.ndarray, keys: np.ndarray) -> None:
        order = np.lexsort((keys, own))
        parts, own, keys = parts[order].astype(np.int16), own[order], keys[order]
        for e in np.unique(own).tolist():
            a, b = np.searchsorted(own, [e, e + 1])
            at = np.searchsorted(self.keys[e], keys[a:b])
            self.members[e], self.keys[e] = np.insert(self.members[e], at, parts[a:b]), np.insert(self.keys[e], at, keys[a:b])

    def owners(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.uint8)
        for e, members in enumerate(self.members):
            out[members] = e
        return out


def advance(x: np.ndarray, heaps: list[Heaps], entries: np.ndarray, drift: np.ndarray, fresh: bool) -> np.ndarray:
    """One round over a block x (n, parts, d). Returns the changes of counts and sums, (parts, entries, 1 + d), and last how many parts were compared."""
    _, parts, d = x.shape
    changes = np.zeros((parts, entries.shape[1], 1 + d), np.int64)
    seen = 0
    for p, own in enumerate(heaps):
        who, left = (np.arange(len(x)), None) if fresh else own.pop(drift[p])
        if not len(who):
            continue
        seen += len(who)
        values = x[who, p]
        now, keys = compared(values, entries[p], drift[p])
        own.push(who, now, keys)
        whole = np.concatenate([np.ones((len(who), 1), np.int64), values], 1)
        moved = np.ones(len(who), bool) if left is None else now != left
        np.add.at(changes[p], now[moved], whole[moved])
        if left is not None:
            np.subtract.at(changes[p], left[moved], whole[moved])
    return np.append(changes.ravel(), seen)


def _pack(x: np.ndarray, heaps: list[Heaps], changes: np.ndarray) -> tuple:
    kind = np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int32
    return (
        x.astype(kind).tobytes(), np.concatenate([m for h in heaps for m in h.members]).astype(np.int16).tobytes(),
        np.concatenate([k for h in heaps for k in h.keys]).astype(np.float32).tobytes(), [len(m) for h in heaps for m in h.members], changes,
    )


def _unpack(row: dict, n: int, parts: int, width: int) -> tuple[np.ndarray, list[Heaps]]:
    data = row["data"]
    x = np.frombuffer(data, np.int16 if len(data) == 2 * n * width else np.int32).astype(np.int64).reshape(n, parts, width // parts)
    cuts = np.cumsum(row["sizes"])[:-1]
    members = np.split(np.frombuffer(row["heap"], np.int16), cuts)
    keys = np.split(np.frombuffer(row["keys"], np.float32), cuts)
    k = len(members) // parts
    return x, [Heaps(members[p * k : p * k + k], keys[p * k : p * k + k]) for p in range(parts)]


def _state(batch_schema: pa.Schema, ids, labels, packed: tuple) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    held = [pa.array([x.tolist() if isinstance(x, np.ndarray) else x], kind) for x, kind in zip(packed, kinds, strict=True)]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, labels)]
    return pa.RecordBatch.from_arrays([*lists, *held], ["ids", "labels", "data", "heap", "keys", "sizes", "changes"])


def _first(entries: np.ndarray, width: int, scale: int, size: int):
    """Rows to blocks, all of whose parts are compared."""
    parts = entries.shape[0]

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, labels, v = (table.column(i).chunk(0) if table.num_rows else pa.array([], table.schema.field(i).type) for i in range(3))
        x = matrix(v, width, scale).reshape(len(v), parts, width // parts)
        heaps = [Heaps.empty(entries.shape[1]) for _ in range(parts)]
        return _state(table.schema, ids, labels, _pack(x, heaps, advance(x, heaps, entries, np.zeros(entries.shape[:2]), True)))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == size:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return run


def _next(entries: np.ndarray, drift: np.ndarray, width: int):
    parts = entries.shape[0]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                row = {name: batch.column(name)[i].as_py() for name in ("data", "heap", "keys", "sizes")}
                x, heaps = _unpack(row, len(ids), parts, width)
                yield _state(batch.schema, ids, labels, _pack(x, heaps, advance(x, heaps, entries, drift, False)))

    return run


def _added(blocks: DataFrame, length: int) -> np.ndarray:
    """The blocks' changes, added up: first in tasks, then by place."""

    def run(batches):
        total = np.zeros(length, np.int64)
        for batch in batches:
            total += batch.column(0).flatten().to_numpy().reshape(-1, length).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["changes"])

    places = blocks.select("changes").mapInArrow(run, "changes array<long>").select(F.posexplode("changes").alias("place", "n"))
    out = np.zeros(length, np.int64)
    for r in places.groupBy("place").agg(F.sum("n").alias("n")).collect():  # one row a part position, entry and component
        out[r["place"]] = r["n"]
    return out


def moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each part's bounds may have come together: its entry's move and the largest move of another entry; a bit more than exact."""
    step = np.sqrt(((new - old).astype(np.float64) ** 2).sum(2)) * (1 + 1e-12)
    out = np.empty_like(step)
    for e in range(step.shape[1]):
        out[:, e] = step[:, e] + np.delete(step, e, 1).max(1, initial=0)
    return out * (1 + 1e-12)


class Codes:
    """What `train` found: entries (parts, entries, d), the blocks with their final heaps, and how many parts each round compared."""

    def __init__(self, entries: np.ndarray, blocks: Table | None, compared_parts: list[int], rows: int):
        self.entries, self.blocks, self.compared, self.rows = entries, blocks, compared_parts, rows

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def codebooks(self, spark) -> DataFrame:
        """(part, entry, value) of the final entries."""
        rows = [(p, e, v) for p, book in enumerate(self.entries.tolist()) for e, v in enumerate(book)]
        return spark.createDataFrame(rows, "part int, entry int, value array<long>")

    def rows_of(self, key_type: str, label_type: str) -> DataFrame:
        """(id, label, code, error) of every kept row."""
        entries, (parts, _, d) = self.entries, self.entries.shape

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                    row = {name: batch.column(name)[i].as_py() for name in ("data", "heap", "keys", "sizes")}
                    x, heaps = _unpack(row, len(ids), parts, parts * d)
                    own = np.stack([h.owners(len(ids)) for h in heaps], 1)
                    error = sum(((x[:, p] - entries[p][own[:, p]]) ** 2).sum(1) for p in range(parts))
                    yield pa.RecordBatch.from_arrays([ids, labels, pa.array([r.tobytes().hex() for r in own], pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

        return self.blocks.read().mapInArrow(run, f"id {key_type}, label {label_type}, code string, error long")


def train(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codes:
    """Codebooks of rows(id, label, v), starting from the rows with the smallest ids."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index must fit a byte")
    kinds = dict(rows.dtypes)
    schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, {STATE}"
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(1, -(-(longest or 0) // parts)) * parts
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()  # `entries` vectors
    start = matrix(pa.array([r["v"] for r in first], pa.list_(pa.float64())), width, scale)
    book = start.reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    if not n:
        return Codes(book, None, [], 0)
    length = parts * len(first) * (1 + width // parts) + 1
    blocks = Table(rows.mapInArrow(_first(book, width, scale, BLOCK), schema), "codes")
    drift, totals, looked = np.zeros(book.shape[:2]), np.zeros(length - 1, np.int64), []
    for _ in range(rounds):
        changes = _added(blocks.read(), length)
        looked.append(int(changes[-1]))
        totals += changes[:-1]
        sums = totals.reshape(parts, len(first), -1)
        counts = sums[:, :, :1]
        new = np.where(counts > 0, sums[:, :, 1:] // np.maximum(counts, 1), book)
        drift, book, before = drift + moves(book, new), new, blocks
        blocks = Table(before.read().mapInArrow(_next(book, drift, width), schema), "codes")
        before.drop()
    looked.append(int(_added(blocks.read(), length)[-1]))
    return Codes(book, blocks, looked, n)


def with_label_total(rows: DataFrame, spread: str) -> DataFrame:
    """rows with label_error, the errors of their label added up (nulls together). A label's rows are dealt over salts, which alone meet the total."""
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), SALTS))
    part = rows.groupBy("label", "__salt").agg(F.sum("error").alias("__e"))
    total = part.groupBy(F.col("label").alias("__label")).agg(F.sum("__e").alias("label_error"), F.collect_list("__salt").alias("__s"))
    total = total.select("__label", "label_error", F.explode("__s").alias("__of"))
    return rows.join(total, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("__of"))).drop("__salt", "__of", "__label")


def op11_vector_codes(spark, sf_dir):
    rows = kept_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    kinds, found = dict(rows.dtypes), train(rows)
    if not found.rows:
        return spark.createDataFrame([], f"vec_id {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string")
    out = with_label_total(found.rows_of(kinds["id"], kinds["label"]), "id")
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))
