"""Best-fit packing by hierarchical residual packing.

Every partition packs its pieces best-fit decreasing, closes bins that are nearly full and sends the underfull ones on
as items. Underfull bins of `FAN_IN` neighbouring groups meet in the next round and are packed again as wholes. A round
has as many groups as keep each below `GROUP_ITEMS` items, so no task holds the corpus; rounds end when one group is
left, or when another round saved too little. Rows stay flat: (piece, bin, place in bin).
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcube.llm.common import batches, table, tokenizer_path
from gapcube.session import written

SEQUENCE = 2048
#: Bins with at most this much free space are closed in an early round.
SLACK = 2
#: White space of so many characters is cut out before the text is split: the pattern backtracks over it and fails at a
#: million (at most one less is left to it).
LONG_RUN = 100_000
#: Items that one task packs at most (a bound on memory: about 100 bytes each).
GROUP_ITEMS = 200_000
FAN_IN = 8
#: Another round must save this share of the open bins, else packing ends.
LEAST_GAIN = 0.001

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", bin long, offset long, used long"


def encoder(path: str):
    """The vocabulary of a tokenizers file as a tiktoken encoding: same ids, about a third of the CPU time."""
    import public_tokenizers
    import tiktoken

    from gapcube.llm.bpe import WHITE
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    coder = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    blanks = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")

    def encode(text: str) -> list[int]:
        ids, at = [], 0
        for m in blanks.finditer(text) if len(text) >= LONG_RUN else ():
            # the last blank before a word is split off, as by the pattern; a special token ends a text
            end = m.end() if m.end() == len(text) or text.startswith(tuple(special), m.end()) else m.end() - 1
            ids += coder.encode(text[at:m.start()], allowed_special="all")
            ids += coder._encode_single_piece(text[m.start():end])
            at = end
        return ids + coder.encode(text[at:], allowed_special="all") if at else coder.encode(text, allowed_special="all")
    return encode


def byte_alphabet() -> dict[str, int]:
    """Byte of each character that stands for it in byte-level vocabularies: visible Latin-1 characters stand for
    themselves, the other bytes in ascending order for the characters from U+0100."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pieces_of(path: str, size: int):
    """Tokens of each document and a closing id 0, cut into pieces of `size`; the remainder comes first."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches(it):
            doc, piece, start, length, crc = [], [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), 0], dtype="<u4")
                cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    doc.append(i), piece.append(k), start.append(x), length.append(y - x), crc.append(zlib.crc32(ids[x:y].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                              pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of every item, and how full each bin is.

    Free space is a small integer, so open bins lie in one stack per free size; a bit mask of the stacks in use finds
    the tightest one that fits.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, n in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> n
        if fits:
            free = (fits & -fits).bit_length() - 1 + n
            k = stacks[free].pop()
            if not stacks[free]:
                mask &= ~(1 << free)
        else:
            free, k = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = k, used[k]
        used[k] += n
        free -= n
        if free:
            stacks[free].append(k)
            mask |= 1 << free
    return bins, offsets, np.array(used, np.int64)


def pack_round(capacity: int, level: int):
    """Pack the bins (or pieces, at level 0) of one partition; a bin is an item whose rows keep their order."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        got = [b for b in it if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        names = t.column_names
        old, place, size = (t["bin"].to_numpy(), t["offset"].to_numpy(), t["used"].to_numpy())
        _, first, item = np.unique(old, return_index=True, return_inverse=True)
        bins, offsets, used = best_fit(size[first], capacity)
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        cols = {"bin": base + bins[item], "offset": place + offsets[item], "used": used[bins[item]]}
        yield from pa.table([pa.array(cols[n]) if n in cols else t[n] for n in names], names=names).combine_chunks().to_batches(max_chunksize=100_000)
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SEQUENCE,
         slack: int = SLACK, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces of all documents with their sequence and place: PIECES, sequence_id, offset.

    Null and empty texts are one piece with the closing id alone. Repeated rows are packed as often as they occur.
    Places in a sequence are gapless from 0. Empty input gives empty output; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(pieces_of(tokenizer or tokenizer_path(), size), PIECES)
    made = written(made.withColumn("bin", F.monotonically_increasing_id()), "pieces")
    own = F.lit(0).cast("long")
    full = made.filter(F.col("length") == size).select("*", own.alias("offset"), F.col("length").alias("used"))
    full = full.withColumn("bin", F.col("bin").bitwiseOR(F.lit(1 << 62)))
    open_ = made.filter(F.col("length") < size).select("*", own.alias("offset"), F.col("length").alias("used"))
    done, level, groups, before = [full], 1, 0, None
    while True:
        packed = written(open_.mapInArrow(pack_round(size, level), PLACED), "packed")
        free = F.lit(size) - F.col("used")
        n, parts = packed.filter((free > slack) & (F.col("offset") == 0)).agg(F.count("*"), F.count_distinct(F.shiftright("bin", 32))).first()
        wanted = -(-n // group_items)
        if n <= 1 or groups == 1 or parts <= 1 or (before is not None and groups <= wanted * fan_in and before - n < LEAST_GAIN * before):
            done.append(packed)
            break
        done.append(packed.filter(free <= slack))
        groups, before, level = max(1, wanted, -(-parts // fan_in)), n, level + 1
        if groups < parts:  # neighbouring partitions meet
            part = F.shiftright("bin", 32).bitwiseAND(F.lit((1 << 24) - 1))
            key = F.pmod(F.floor(part / F.lit(-(-parts // groups))), F.lit(groups))
        else:  # groups can't get fewer: deal the bins anew
            key = F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups))
        open_ = packed.filter(free > slack).withColumn("_g", key).repartition(groups, "_g").drop("_g")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def op1_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
