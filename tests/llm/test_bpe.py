import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumage.llm.bpe import Vocabulary, bpe_decode, bpe_encode

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(open(PATH, "rb").read())


def texts():
    rng = random.Random(5)
    hard = ["", " ", "Don't we'll I'M", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ ǅ straße", "x\u0085y z\x1cw\x1f", "é́ ﬁ ½ ²", "</w> <w>", "日本語テキスト 😀😀", "​", "it's 's", "aaaaaaaaaaaaaaaa" * 9, "<|endoftext|>"]
    letters = "etaoinshrdlu"
    hard += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    hard += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 700), rng.randint(0x300, 0x3ff), rng.randint(0x4e00, 0x4f00), rng.randint(0, 40)])) for _ in range(40)) for _ in range(400)]
    return hard


def test_encode_equals_library(vocab):
    todo = texts()
    for text, (ids, decoded) in zip(todo, vocab.encode(todo)):
        want, back = expected(text)
        assert ids == " ".join(map(str, want)), text
        assert decoded == back, text


def test_pairs_against_merging(vocab):
    """The array test agrees with exact merging, whether greedy was right or not."""
    wrong = 0
    for w in texts()[13:1500]:
        guess = vocab.guess(w)
        ok = all(vocab.compatible(*__import__("numpy").array([[a], [b]]))[0] for a, b in zip(guess, guess[1:]))
        assert ok == (guess == vocab.merged(w))
        wrong += not ok
    assert wrong > 20


def test_query(spark):
    data = [(1, "Hello world, it's", 3), (2, None, 3), (3, "", 3), (3, "", 3), (None, "x<|endoftext|>", 3), (5, "long " * 50_000, 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe_encode(df, PATH, digest=True).collect()), key=str)
    want = []
    for i, t, _ in data:
        ids, back = expected(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    plain = bpe_decode(bpe_encode(df, PATH).withColumnRenamed("decoded", "was"), PATH)
    assert plain.where("decoded <> was").count() == 0
    assert bpe_encode(df.limit(0), PATH).count() == 0


def test_other_vocabularies_are_refused(spark, tmp_path):
    import json

    spec = json.load(open(PATH))
    for change in ({"normalizer": None}, {"model": spec["model"] | {"end_of_word_suffix": None}}, {"decoder": {"type": "ByteLevel"}}):
        path = tmp_path / "v.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="doesn't have"):
            bpe_encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(path))
    got = bpe_encode(spark.createDataFrame([("x", "Hello", 1)], "`my.id` string, text string, `a.b` int"), PATH, "my.id").collect()
    assert [(r.doc_id, r.decoded) for r in got] == [("x", expected("Hello")[1])]
