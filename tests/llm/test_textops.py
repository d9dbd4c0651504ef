import pyarrow as pa
from slotforge.llm import textops


def test_long_words_of_the_same_blocks_differ():
    a, b = "a" * 4096, "b" * 4096
    hashes = textops.Words(pa.array([a + b, b + a, a + b, a + a, b, a + b + "x"])).hashes.tolist()
    assert hashes[0] == hashes[2] and len(set(hashes)) == 5
    # the same word has the same hash whatever stands beside it
    assert textops.Words(pa.array(["x y " + b])).hashes[2] == hashes[4]


def test_slices_cover_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}" * (i % 50) for i in range(300)])], ["t"])
    assert [x for part in textops.slices(batch, 0, 100) for x in part.column(0).to_pylist()] == batch.column(0).to_pylist()
