"""Segmentations against a plain Viterbi search over the whole text; round trips."""

import random

import numpy as np

from floodspark.llm import sentencepiece as sp
from floodspark.llm.queries import tokenizer_file

FILE = tokenizer_file("piece_bpe_32k.model")
MODEL = sp.load_pieces(FILE)


def plain(text, scores, ids):
    text = "▁" + text.replace(" ", "▁")
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        options = []
        for width in range(1, min(16, end) + 1):
            piece = text[end - width:end]
            if piece in scores:
                options.append((best[end - width][0] + scores[piece], width, [ids[piece]]))
            elif width == 1:
                options.append((best[end - 1][0] + sp.FALLBACK, 1, [int(MODEL["byte_ids"][b]) for b in piece.encode()]))
        score, width, last = max(options, key=lambda o: o[:2])
        best.append((score, best[end - width][1] + last))
    return best[-1][1]


def test_segmentation_and_round_trip():
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=FILE)
    names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    own = [i for i in range(len(names)) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]
    scores = {names[i]: float(np.round(-np.log(k + 2.0) * 2**20) / 2**20) for k, i in enumerate(own)}
    ids = {names[i]: i for i in own}
    rng = random.Random(2)
    texts = ["Hello  world\nfoo", " ", "   ", "a ", " lead", "né ü ß 日本 🎉 x", "end\n", "x" * 100]
    texts += ["".join(rng.choice("the andé \n日zq,.0") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    encoder = sp.Encoder(MODEL)
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == plain(text, scores, ids), text
        assert encoder.decode(got) == text
        assert processor.decode(np.frombuffer(got, "<u4").tolist()) == text or text.startswith(" ")


def test_forgetting_changes_nothing():
    texts = [f"word{k} and other{k * 7} things" for k in range(200)]
    assert sp.Encoder(MODEL, limit=20).encode(texts) == [sp.Encoder(MODEL).encode([t])[0] for t in texts]


def test_edges(spark, edge_docs, no_docs):
    encoded = sp.encode(edge_docs, FILE)
    rows = encoded.collect()
    assert len(rows) == edge_docs.count() and all(r.round_trip for r in rows)
    assert all(r.n_tokens == 0 for r in rows if r.doc_id in (1, 2))
    texts = {(r.doc_id, r.text or "") for r in edge_docs.collect()}
    assert {tuple(r) for r in sp.decode(encoded, FILE).collect()} == texts
    assert sp.encode(no_docs, FILE).count() == 0
