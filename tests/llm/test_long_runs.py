import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chainframes.llm.packing import WholeTokenizer, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000, " \t\n" * 700_000, " " * 90_000])
def test_long_white_space_is_encoded(run):
    text = f"a{run}b"
    own = WholeTokenizer(PATH)
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False)
    own._left = 0
    assert own.ids(text).tolist() == want.ids and list(map(tuple, own.spans(text).tolist())) == want.offsets


def test_one_such_row_does_not_end_the_job(spark):
    rows = [(1, "a" + " " * 2_000_000 + "b"), (2, " " * 2_000_000), (3, "plain words"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = pack_documents(docs, PATH).groupBy("doc_id").sum("length").collect()
    want = {i: len(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
    assert {r[0]: r[1] for r in pieces} == want
