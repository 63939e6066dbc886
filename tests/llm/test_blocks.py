from __future__ import annotations

import numpy as np

from millrace.llm import blocks


def test_equal_windows_choose_alike_in_blocks_of_any_size():
    rng = np.random.default_rng(2)
    for apart in (0, 3, 10, 20, 31, 40, 63):
        window = rng.integers(0, 1 << 63, 9, dtype=np.uint64)
        window[3] = window[7] = window.min() // np.uint64(2)
        window[7] ^= np.uint64(1 << apart)
        around = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
        alone = blocks.least_at(window, 9)[0]
        for at in (0, 1, 70, 4000):
            h = np.concatenate([around[:at], window, around[at:]])
            assert blocks.least_at(h, 9)[at] - at == alone


def test_the_first_of_equal_hashes():
    h = np.array([7, 7, 7, 7], dtype=np.uint64) << np.uint64(40)
    assert blocks.least_at(h, 2).tolist() == [0, 1, 2]
    assert blocks.least_at(h, 5).tolist() == []
