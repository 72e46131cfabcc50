"""The pipeline's near-dedup stage finds its links by SimHash first."""

import numpy as np

from spendtrail.llm import simhash


def test_wide_fingerprints_find_near_copies_and_part_others():
    rng = np.random.default_rng(23)
    width = simhash.block_bits(10_000)
    bound = simhash.print_distance(simhash.PRINT_BITS // width * width, 0.8)
    found, parted = 0, 0
    for _ in range(100):
        a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        b, other = np.concatenate((a[:290], rng.integers(0, 1 << 63, 10, dtype=np.uint64))), rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        x, y, z = (simhash.wide_fingerprint(s, width) for s in (a, b, other))
        apart = lambda v, w: sum((i ^ j).bit_count() for i, j in zip(v, w, strict=True))
        found += any(i == j for i, j in zip(x, y, strict=True)) and apart(x, y) <= bound
        parted += apart(x, z) > bound
    assert found >= 95 and parted == 100
    assert set(simhash.wide_fingerprint(a[:0], width)) == {0}
