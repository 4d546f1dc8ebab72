import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from yieldscope.llm import pieces, token_file

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n):
    draw = random.Random(8)
    signs = list("abcXYZ  \n\t.,'!<|>019éÉßΣςİ̸́ K　日本😀=-'st")
    return ["", "<|endoftext|>x<|startoftext|>", "don't we're I'LL 'three'", "  a  b ", "<s>x</s><unk><0x41>"] + [
        "".join(draw.choice(signs) for _ in range(draw.randint(0, 50))) for _ in range(n)]


def test_blocks_give_their_ids_back():
    draw = random.Random(2)
    for n in (0, 1, 2, 4095, 4096, 4097, 9000):
        ids = np.array([draw.randrange(2 ** draw.choice([1, 8, 15, 32])) for _ in range(n)], np.uint32)
        assert (token_file.read_page(*token_file.page(ids)) == ids).all()


def test_file_against_the_library(spark, docs, messy, tmp_path):
    rows = messy + [(1000 - i, t) for i, t in enumerate(odd_texts(400))]
    path = str(tmp_path / "tokens")
    token_file.write(docs(rows), path, WORDS, end_id=2)
    whole = Tokenizer.from_file(WORDS)
    expected = {}
    for i, t in rows:
        expected.setdefault(i, []).append([*whole.encode(t or "", add_special_tokens=False).ids, 2])
    got = sorted(token_file.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    place = 0
    for r in got:
        assert r.start == place and r.ids in expected[r.doc_id]
        place += len(r.ids)
    digests = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_file.read(spark, path, digest=True).collect()}
    assert digests == {(r.doc_id, r.start): (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}


def test_rows_of_one_id_come_by_text(spark, docs, tmp_path):
    rows = [(3, f"text {i % 7}") for i in range(40)] + [(2, "z"), (4, "a")]
    token_file.write(docs(rows, 7), str(tmp_path / "tokens"), WORDS, end_id=2)
    whole = Tokenizer.from_file(WORDS)
    got = sorted(token_file.read(spark, str(tmp_path / "tokens")).collect(), key=lambda r: r.start)
    assert [r.ids for r in got] == [[*whole.encode(t, add_special_tokens=False).ids, 2] for _, t in sorted(rows)]


def test_an_empty_file(spark, docs, tmp_path):
    token_file.write(docs([]), str(tmp_path / "none"), WORDS)
    assert token_file.read(spark, str(tmp_path / "none")).count() == 0


def test_pieces_against_the_library_and_back(docs, messy):
    rows = messy + [(1000 + i, t) for i, t in enumerate(odd_texts(400))]
    held = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = pieces.encode(docs(rows), [F.col("doc_id"), F.col("text").alias("was")], PIECES)
    got = encoded.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == held.encode(r.was or "")
    for r in pieces.decode(encoded, [F.col("was")], PIECES).collect():
        assert r.text == (r.was or "").replace("▁", " ")
    assert pieces.encode(docs(rows), [F.col("doc_id")], PIECES, digest=True).where("not round_trip").count() == 0
    assert pieces.encode(docs([]), [F.col("doc_id")], PIECES).count() == 0


def test_the_stream_commits_within_a_bounded_window():
    model, held = pieces.Model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    draw = random.Random(3)
    for text in ("a" * 3000, "ab" * 2000, "".join(draw.choice("abcdefgh") for _ in range(5000)), "日本語" * 500):
        stream, out = pieces.Stream(model), []
        at = 0
        while at < len(text):
            step = draw.randint(1, 300)
            out += stream.feed(" " + text[:step] if not at else text[at:at + step])
            at += step
            assert len(stream.text) < 12 * model.longest
        out += stream.close()
        assert model.id_list(out) == held.encode(text)
