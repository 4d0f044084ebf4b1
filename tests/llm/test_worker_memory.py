"""What a Python worker holds beside the batch at hand does not grow with the batch."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from pulsemap.llm import langid, packing
from pulsemap.llm import queries as Q


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 5))) for _ in range(n))


def test_languages_in_lots():
    r = np.random.default_rng(1)
    model = langid.Model(list("abcd"), r.random((langid.BUCKETS, 4)).astype(np.float32), np.zeros(4))
    some = [words(300, k) for k in range(50)] + ["", "12", "é世 ß"]
    many = some * 40  # 3 MB
    assert peak_mb(lambda: model.judge(many)) < 30
    assert model.judge(many)[2].tolist() == [t not in ("", "12") for t in many]
    long = words(1000, 9) * 300
    lots = list(langid.pieces_of([*many, long]))
    whole = [""] * (len(many) + 1)
    for lot, owner in lots:
        for piece, at in zip(lot, owner, strict=True):
            whole[at] += piece
    assert whole == [*many, long]
    assert all(sum(map(len, lot[:-1])) < langid.LOT for lot, _ in lots)


def test_tokens_in_parts():
    tokenizer = packing.WordTokenizer(Q.vocabulary("word_bpe_49k.json"))
    some = [words(2000, k) for k in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800), pa.int64()), pa.array(some * 16)], ["doc_id", "text"])  # 8 MB
    tokenizer.encode(some)
    parts = []

    def run():
        for part in packing.batches_of(batch, 1, packing.BATCH_BYTES):
            parts.append(len(part))
            tokenizer.encode(part.column(1))

    assert peak_mb(run) < 80 and sum(parts) == 800
