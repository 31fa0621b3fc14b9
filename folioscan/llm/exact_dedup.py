"""Exact deduplication by deterministic block naming.

Every text is cut into fixed-size blocks. Sorting the distinct blocks gives each an integer name; adjacent
names of a document are then named as pairs, again by sorting, and so on until one name is left. Names stand
for whole contents, never for hashes of them, so two documents share an identity exactly if their texts are equal.

Scale. A task first finds the equal texts and equal blocks of its own batch of rows, so a text that fills a third of
the corpus travels once per batch rather than once per row; blocks are dealt out by a hash of their content and sorted
inside each bucket; there are as many buckets as the number of blocks asks for. A block that every batch holds is a row
per batch: the batches are dealt to parts of at most PART_BATCHES, each part names its own blocks first, and only the
distinct ones of the parts meet. Only names move after that. The batches are written to the shared folder, so their numbers are
fixed before anything refers to them.

Cases. Null text: as empty. Null doc_id: ordered before every other id. Empty table: no rows. Repeated rows (same
doc_id, same text): each is a row of the result and counts in group_size; exactly one row of a group is kept. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import NO_ID, doc_rows, written

BLOCK_BYTES = 4096
#: Blocks of a hash bucket, within which they are sorted, and the least number of buckets.
BUCKET_BLOCKS = 4096
BUCKETS = 1024
#: Batches of a part.
PART_BATCHES = 100_000

_LOCAL = "kind string, batch long, uid int, local int, block binary, doc_id long, sha string, leads boolean, copies long, top long, locals array<int>"
_FIELDS = ("kind", "batch", "uid", "local", "block", "doc_id", "sha", "leads", "copies", "top", "locals")
_TYPES = pa.schema([("kind", pa.string()), ("batch", pa.int64()), ("uid", pa.int32()), ("local", pa.int32()), ("block", pa.binary()), ("doc_id", pa.int64()), ("sha", pa.string()), ("leads", pa.bool_()), ("copies", pa.int64()), ("top", pa.int64()), ("locals", pa.list_(pa.int32()))])


def _table(kind: str, **columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns["kind"] = [kind] * n
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f, [None] * n), _TYPES.field(f).type) for f in _FIELDS], schema=_TYPES)


def _batch_namer(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            number = (part << 32) | k
            ids = [NO_ID if d is None else d for d in batch.column("doc_id").to_pylist()]
            uid_of: dict[bytes, int] = {}
            uids = [uid_of.setdefault(t, len(uid_of)) for t in batch.column("text").to_pylist()]
            leader: list[int] = [-1] * len(uid_of)
            copies = [0] * len(uid_of)
            for row, u in enumerate(uids):
                copies[u] += 1
                if leader[u] < 0 or ids[row] > ids[leader[u]]:
                    leader[u] = row
            shas, lists, local_of = [], [], {}
            for text in uid_of:
                shas.append(hashlib.sha256(text).hexdigest())
                lists.append([local_of.setdefault(text[i : i + block_bytes], len(local_of)) for i in range(0, max(1, len(text)), block_bytes)])
            b = lambda rows: [number] * len(rows)
            if uids:
                yield _table("row", batch=b(uids), uid=uids, doc_id=ids, sha=[shas[u] for u in uids], leads=[leader[u] == r for r, u in enumerate(uids)])
                yield _table("text", batch=b(lists), uid=list(range(len(lists))), copies=copies, top=[ids[r] for r in leader], locals=lists)
                blocks = list(local_of)
                for i in range(0, len(blocks), 2048):
                    part_of = blocks[i : i + 2048]
                    yield _table("block", batch=b(part_of), local=list(range(i, i + len(part_of))), block=part_of)

    return run


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, part_batches: int = PART_BATCHES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows(batch, uid, doc_id, sha, leads), and for each distinct text of a batch its identity (level, name)."""
    local = written(doc_rows(docs, id_col, text_col).mapInArrow(_batch_namer(block_bytes), _LOCAL))
    rows = local.where("kind = 'row'").select("batch", "uid", "doc_id", "sha", "leads")
    texts = local.where("kind = 'text'").select("batch", "uid", "copies", "top", "locals")

    held = local.agg(F.count_if(F.col("kind") == "block"), F.coalesce(F.max(F.size("locals")), F.lit(1)), F.count_if((F.col("kind") == "text") & (F.col("uid") == 0))).first()
    buckets, most, n_parts = max(BUCKETS, held[0] // BUCKET_BLOCKS + 1), held[1], held[2] // part_batches + 1
    bucket = F.pmod(F.xxhash64("block"), F.lit(buckets))
    blocks = local.where("kind = 'block'").select("batch", "local", "block", bucket.alias("bucket"))
    names = _named_blocks(blocks, n_parts).select("batch", "local", (F.col("rank").cast("long") * buckets + F.col("bucket")).alias("name"))
    parts = texts.select("batch", "uid", F.posexplode("locals").alias("at", "local"))
    state = written(parts.join(names, ["batch", "local"]).select("batch", "uid", F.col("at").cast("long").alias("at"), "name"))

    done, level = None, 0
    counts = texts.select("batch", "uid", F.size("locals").alias("n"))
    state = state.join(counts, ["batch", "uid"])
    while True:
        single = state.where("n = 1").select("batch", "uid", F.lit(level).alias("level"), "name")
        done = single if done is None else done.unionByName(single)
        if most <= 1:
            return rows, texts.drop("locals").join(done, ["batch", "uid"])
        most, level = (most + 1) // 2, level + 1
        state = _named_pairs(state.where("n > 1"), buckets)


def _named_blocks(blocks: DataFrame, n_parts: int) -> DataFrame:
    """(batch, local, bucket, rank): the place of each block among the distinct ones of its bucket."""
    if n_parts == 1:
        return blocks.select("batch", "local", "bucket", F.dense_rank().over(Window.partitionBy("bucket").orderBy("block")).alias("rank"))
    parts = blocks.withColumn("part", F.pmod(F.xxhash64("batch"), F.lit(n_parts)))
    own = Window.partitionBy("bucket", "part").orderBy("block")
    parts = parts.select("*", F.dense_rank().over(own).alias("own"), (F.coalesce(F.lag("block").over(own) != F.col("block"), F.lit(True))).alias("first"))
    ranked = parts.where("first").select("bucket", "part", "own", F.dense_rank().over(Window.partitionBy("bucket").orderBy("block")).alias("rank"))
    return parts.select("batch", "local", "bucket", "part", "own").join(ranked, ["bucket", "part", "own"]).select("batch", "local", "bucket", "rank")


def _named_pairs(state: DataFrame, buckets: int) -> DataFrame:
    """One level up: adjacent names (2i, 2i+1) of each text get one name; a last name without a neighbour pairs with -1."""
    one = lambda side: F.max(F.when(F.col("at") % 2 == side, F.col("name")))
    pairs = state.groupBy("batch", "uid", "n", F.floor(F.col("at") / 2).alias("up")).agg(one(0).alias("a"), F.coalesce(one(1), F.lit(-1)).alias("b"))
    pairs = written(pairs.withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(buckets))))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("a", "b"))
    names = written(pairs.select("bucket", "a", "b").distinct().select("a", "b", (rank.cast("long") * buckets + F.col("bucket")).alias("name")))
    up = F.floor((F.col("n") + 1) / 2).cast("int")
    return pairs.join(names, ["a", "b"]).select("batch", "uid", F.col("up").cast("long").alias("at"), "name", up.alias("n"))


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, part_batches: int = PART_BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs. Of equal texts the row with the largest doc_id stays."""
    rows, texts = identities(docs, block_bytes, part_batches, id_col, text_col)
    texts = written(texts)
    groups = texts.groupBy("level", "name").agg(F.sum("copies").alias("group_size"), F.max(F.struct("top", "batch", "uid")).alias("best"))
    of_text = texts.join(groups, ["level", "name"]).select("batch", "uid", "group_size", F.col("best.top").alias("keep"), (F.struct("batch", "uid") == F.struct("best.batch", "best.uid")).alias("holds"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.join(of_text, ["batch", "uid"]).select(
        real("doc_id").alias("doc_id"), real("keep").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("holds") & F.col("leads")).alias("kept"), F.col("sha").alias("text_sha256")
    )
