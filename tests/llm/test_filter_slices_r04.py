"""A slice of the language model's filter is held once, on the driver and in each worker."""

import tracemalloc

import numpy as np

from formulake.llm import ngram_lm as L


def test_a_slice_fits_a_driver_of_1500_mb():
    assert L.MOST_BYTES <= 128 << 20


def test_parts_that_come_one_by_one_are_held_once():
    sizes = {k: 1 << 20 for k in range(30, 0, -3)}
    tracemalloc.start()
    found = L.Filter(((k, bytes([k]) * n) for k, n in sizes.items()), 31, sizes=sizes)
    assert tracemalloc.get_traced_memory()[1] < 13 << 20
    tracemalloc.stop()
    whole = L.Filter({k: bytes([k]) * n for k, n in sizes.items()}, 31)
    assert np.array_equal(found.bytes, whole.bytes)
    assert np.array_equal(found.first, whole.first) and np.array_equal(found.bits, whole.bits)


def test_slices_hold_every_segment_once(spark):
    parts = spark.createDataFrame([(k, bytes(k)) for k in range(1, 9)], "segment int, bits binary")
    found = L.slices_of(parts, 10)
    assert found == [{1: 1, 2: 2, 3: 3, 4: 4}, {5: 5}, {6: 6}, {7: 7}, {8: 8}]
    assert L.slices_of(parts.limit(0), 10) == [{}]
