"""What executors and their workers must not hold or start."""

import os

import public_tokenizers
import pyarrow as pa

from tessella.llm import pieces
from tessella.plans.lineage import written


def test_written_tables_start_no_process_for_each_file(spark):
    """Hadoop's usual local class runs chmod for a file and for its checksum; where it is not used there are no checksums."""
    out = written(spark.range(100).repartition(4), "plain")
    names = os.listdir(out._written_at.removeprefix("file://"))
    assert sum(x.endswith(".parquet") for x in names) == 4 and not [x for x in names if x.endswith(".crc")]
    assert out.count() == 100


def test_encoding_keeps_nothing_of_the_texts():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some plain words", None])], names=["doc_id", "text"])
    f, types = (lambda p, t: (len(ids := p.encode(t)), ids)), (pa.int64(), pa.list_(pa.int32()))
    run = pieces._encoding(model, f, "doc_id long, n_tokens long, ids array<int>", types)
    assert [x.column(1).to_pylist() for x in run(iter([rows]))] == [[len(pieces.pieces(model).encode("some plain words")), 1]]
    pieces.pieces(model).forget()
    list(run(iter([rows])))
    own = pieces.pieces(model)
    assert not own.memo and not own.older and not own.fits
