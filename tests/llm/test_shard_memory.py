"""Memory of the shard step of repeated passages, and that it finds the same windows in shards of any size."""
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from gapcube.llm import repeats
from gapcube.llm.suffix import suffix_array

NAMES = ["fp", "ctx", "n", "doc", "twin", "place", "left", "bytes"]


def contexts(anchors: int, each: int) -> pa.RecordBatch:
    """Contexts of made-up text, sorted by anchor; the left halves of every third pair are alike."""
    draw, rows = random.Random(5), []
    for a in range(anchors):
        for k in range(each):
            text = bytes(draw.choices(b"abcdefgh  etaoin", k=336))
            if k % 3 == 1:
                text = rows[-1][7][:250] + text[250:]
            rows.append((a, a * each + k, 1, a * each + k, 0, 1000, 136, text))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=NAMES)


def found(b: pa.RecordBatch, shard_bytes: int) -> list:
    step = repeats.shard_spans(200, 64, shard_bytes)
    return sorted((r["fp"], r["ctx"], str(r["spans"])) for o in step(iter(b.slice(i, 500) for i in range(0, b.num_rows, 500))) for r in o.to_pylist())


def test_a_shard_takes_few_bytes_for_each_of_its_own():
    b = contexts(40, 78)  # 1 MB
    whole = 1 << 19
    found(b.slice(0, 100), whole)
    tracemalloc.start()
    found(b, whole)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 * whole, peak / whole


def test_suffix_arrays_of_short_texts_have_32_bits():
    text = np.append(np.frombuffer(b"banana bandana", np.uint8).astype(np.uint16) + 1, 0)
    sa = suffix_array(text, 257)
    assert sa.dtype == np.int32
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_spans_do_not_depend_on_the_size_of_shards():
    b = contexts(12, 30)
    alike = found(b, 1 << 21)
    assert len(alike) == 12 * 20
    assert found(b, 30 * 336) == found(b, 3 * 30 * 336) == alike
