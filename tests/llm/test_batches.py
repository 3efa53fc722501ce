"""What Python workers hold while they wait."""

import numpy as np

from sealtrail.llm.batches import give_back


def _resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


def test_freed_memory_goes_back_although_some_of_it_is_still_held():
    blocks = [np.ones(2_000) for _ in range(10_000)]  # 160 MB in pieces that malloc does not map one by one
    held = blocks[::1_000]
    del blocks
    before = _resident()
    give_back()
    assert _resident() < before - 60 and sum(len(b) for b in held) == 20_000
