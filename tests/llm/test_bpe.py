from __future__ import annotations

import base64
import functools

import public_tokenizers
import regex
import tiktoken
from cases import frame, rows

from stagegraph.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


def test_ids_are_those_of_the_library_and_decode_to_the_text(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(frame(spark), PATH, public_tokenizers.PATTERN, chunk_words=2000)
    got = sorted((repr(r.doc_id), list(r.ids), bytes(r.data)) for r in bpe.decode(encoded, PATH).collect())
    assert got == sorted((repr(r[0]), library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows())


def test_empty_table(spark):
    assert bpe.encode(frame(spark, []), PATH, public_tokenizers.PATTERN).collect() == []


def test_special_tokens_are_plain_text(spark):
    docs = spark.createDataFrame([(1, "<|endoftext|>")], "doc_id long, text string")
    row = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).first()
    assert bytes(row.data) == b"<|endoftext|>" and len(row.ids) > 1


def test_every_code_point_is_split_as_the_library_does(spark):
    ranks = bpe.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    split, piece = bpe.splitter(public_tokenizers.PATTERN), functools.cache(library._encode_single_piece)
    classes = [bpe.library_class(x) for x in (r"\p{L}", r"\p{N}", r"\s")]
    differ = [c for c in points if any((c in k) != bool(regex.match(x, c)) for k, x in zip(classes, (r"\p{L}", r"\p{N}", r"\s"), strict=True))]
    assert len(differ) > 1000
    for form, some in (("a{0}1 {0}{0}", points), ("1{0}a\n{0}\n", differ), ("'{0}.{0}é ", differ), ("{0}", differ)):
        for i in range(0, len(some), 1 << 14):
            text = "".join(map(form.format, some[i : i + (1 << 14)])) if form != "{0}" else "".join(f"{c} " for c in some)
            assert [t for w in split(text) for t in piece(w.encode())] == library.encode_ordinary(text)
    odd = spark.createDataFrame([(1, "".join(f"a{c}1 {c}" for c in "\u0558\u088f\ua7ce\U00010940\U0001fbf0")), (None, "a\u0558b")], "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(odd, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {r.doc_id: library.encode_ordinary(r.text) for r in odd.collect()}


def test_digests_need_no_second_worker(spark):
    apart = bpe.digests(bpe.encode(frame(spark), PATH, public_tokenizers.PATTERN, chunk_words=2000), PATH)
    one = bpe.encoded_digests(frame(spark), PATH, public_tokenizers.PATTERN, chunk_words=2000)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, apart.collect()))
    assert "MapInArrow" not in one._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
