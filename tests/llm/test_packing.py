"""Sum-of-squares packing: the choice of level, wholeness, tightness, bounds."""

import time

import numpy as np

from pulsemap.llm import packing


def run(sizes, **given):
    """All windows of documents of these sizes, in the order they close, and the packer."""
    p = packing.SumOfSquares(**given)
    windows = [w for i, n in enumerate(sizes) for w in p.add(i, np.arange(n, dtype="<u4").tobytes())]
    return windows + list(p.drain()), p


def whole_and_tight(sizes, windows, capacity):
    got = {}
    for w in windows:
        total = sum(map(len, w))
        assert total == capacity or total & (total - 1) == 0
        for x in w:
            got.setdefault(x.doc_id, []).append((x.start, np.frombuffer(x.ids, "<u4").tolist()))
            assert x.doc_tokens == sizes[x.doc_id]
    for i, n in enumerate(sizes):
        assert [v for _, ids in sorted(got.get(i, [])) for v in ids] == list(range(n))


def test_level_is_the_least_sum_of_squares():
    r = np.random.default_rng(0)
    for _ in range(300):
        p = packing.SumOfSquares(64, levels=16)
        for fill in r.integers(1, 61, 30):
            if r.random() < 0.5:
                w = packing.Window()
                w.fill = int(fill)
                p.open[p.level(w.fill)].append(w)
                p.count[p.level(w.fill)] += p.level(w.fill) < p.top
        size, costs = int(r.integers(1, 64)), {}
        for h in [0, *(h for h in range(1, p.top) if p.open[h] and p.open[h][-1].fill + size <= 64)]:
            fill = size + (p.open[h][-1].fill if h else 0)
            after = np.array(p.count)
            after[h] -= h > 0
            after[p.level(fill)] += p.level(fill) < p.top
            costs[h] = int((after[1 : p.top] ** 2).sum())
        assert p.level_for(size) == max(k for k, v in costs.items() if v == min(costs.values()))


def test_whole_and_tight_at_any_size():
    r = np.random.default_rng(1)
    for capacity, levels in ((2048, 32), (64, 64), (16, 4), (1, 1)):
        for n in (0, 1, 7, 300):
            sizes = [int(x) for x in r.geometric(1.5 / capacity if capacity > 1 else 0.5, n)]
            windows, _ = run(sizes, capacity=capacity, levels=levels)
            whole_and_tight(sizes, windows, capacity)


def test_open_windows_stay_bounded():
    sizes = [1100] * 500  # no two fit together
    p = packing.SumOfSquares(2048, 32, most_open=50)
    windows = []
    for i, n in enumerate(sizes):
        windows += p.add(i, np.arange(n, dtype="<u4").tobytes())
        assert sum(map(len, p.open)) <= 50
    windows += p.drain()
    whole_and_tight(sizes, windows, 2048)


def test_the_levels_place_nearly_all():
    """The share that is poured together at the end of a partition of 1,250 documents is small; it falls with its size."""
    r = np.random.default_rng(2)
    shares = []
    for n in (1250, 10_000):
        _, p = run([int(x) + 1 for x in np.minimum(r.lognormal(6.4, 0.9, n), 20_000)])
        shares.append(p.poured / (p.poured + p.placed))
    assert shares[0] < 0.1 and shares[1] < 0.02


def test_a_very_long_document_takes_linear_time():
    took = []
    for n in (1 << 21, 1 << 23):
        began = time.process_time()
        windows, _ = run([n])
        took.append(time.process_time() - began)
        assert sum(len(x) for w in windows for x in w) == n
    assert took[1] < 12 * took[0] + 0.5


def test_a_long_text_in_parts_is_the_whole_text():
    from pulsemap.llm import queries

    own = packing.word_tokenizer(queries.vocabulary("word_bpe_49k.json"))
    text = "Lorem ipsum, d'olor <|endoftext|> ÉTÉ sit. " * 3000 + "x" * 5000
    assert own.encode_long(text, 1000) == own.encode([text])[0]
