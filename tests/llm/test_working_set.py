"""What a task holds at once: blocks that fit the cache, however much text a batch has."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm import bwt_dedup, context_mixing

from .test_operators import random_model


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_contexts_are_found_a_small_block_at_a_time():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 123, 4000, np.uint8)).decode() for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([1] * 1000, pa.int64()), pa.array(texts)], ["dkey", "copies", "text"])
    sizes = []
    assert peak(lambda: sizes.extend(len(b) for b in bwt_dedup.count_contexts(iter([batch])))) < 40e6
    assert min(sizes[:-1]) >= bwt_dedup.BATCH


def test_bits_are_held_for_a_step_alone():
    model = random_model()
    rng = np.random.default_rng(5)
    text = rng.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), 1 << 18)
    assert peak(lambda: model.bits(text, np.arange(0, len(text) + 1, 1 << 12))) < 250 * len(text)
