import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from symptia.llm import byte_bpe

from .conftest import EDGES

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = [" ", "  ", "\n", "\t", "a", "É", "ß", ".", ",", "'s", "'re", "12", "३", "漢", " ", "　", "\x1c", "é", "😀", "_",
         "½", "x" * 50, " the", "'ll", "-", "\r\n", " ", "ǅ", "\x00"]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_tiktoken_and_back():
    codec = byte_bpe.Codec(open(PATH, "rb").read(), PATTERN)
    rng, encoding = random.Random(1), reference()
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    for text, ids in zip(texts, codec.encode_all(texts)):
        assert ids == ",".join(map(str, encoding.encode_ordinary(text))), text
        assert codec.decode(ids) == text.encode()
    assert not codec.unmerged


def test_a_token_no_merge_leads_to():
    # "abc" is a token, but neither "ab" nor "bc" is
    lines = [(bytes([b]), b) for b in range(256)] + [(b"abc", 256)]
    codec = byte_bpe.Codec(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in lines), PATTERN)
    assert codec.encode("abc") == "256" and codec.encode("abcd") == "97,98,99,100"


def test_documents(edges, docs):
    encoding = reference()
    found = byte_bpe.encoding_digests(edges, PATH, PATTERN).collect()
    want = []
    for i, text in EDGES:
        ids = encoding.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    whole = byte_bpe.encode_documents(edges, PATH, PATTERN).filter("doc_id = 6").first()
    assert bytes(whole.decoded).decode() == "Ünï çödé 漢字 😀" and whole.n_tokens == whole.ids.count(",") + 1
    assert byte_bpe.encoding_digests(docs([]), PATH, PATTERN).collect() == []
