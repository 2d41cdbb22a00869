from isolates.llm import op6_packing
from tests.llm.corpus import SCHEMA


def test_packing_of_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["la <|endoftext|> lo", "<|endoftext|>", "a  <|endoftext|><|endoftext|>  \n b", "<|endoftext|", "plain words", "<|endo<|endoftext|>text|>"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.ids for r in op6_packing.pieces(docs, with_ids=True).collect()}
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
