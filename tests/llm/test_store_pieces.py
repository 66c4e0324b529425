"""Pieces of the token store that are lower-cased or encoded in bulk, against the library."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from cairn.llm import token_store
from cairn.llm.runtime import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def check(library, known, texts):
    split = [token_store.words(t.encode()) for t in texts]
    known.learn(split)
    for ws, e in zip(split, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(b"".join(map(known.__getitem__, ws)), "<u4").tolist() == e.ids


def test_letters_of_ascii_are_lowered_beside_any_code_point(library):
    known = token_store._Pieces(tokenizer_path())
    assert token_store.words("Die Straße, GRÜN.".encode()) == ["die".encode(), "straße".encode(), b",", "grÜn".encode(), b"."]
    assert token_store.words("J̌ A".encode()) == ["J̌".encode(), b"A"]
    points = [c for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 5000):
        check(library, known, [f"A{chr(c)}B, {chr(c)}C. Xy{chr(c)}!? Zé{chr(c)}É, {chr(c)}̨Å" for c in points[i : i + 5000]])
        check(library, known, [f"A{chr(c)}B, {chr(c)}C. Xy{chr(c)}!? Zé{chr(c)}É, x{chr(c)}." for c in points[i : i + 5000]])


def test_words_of_latin_letters_go_to_the_model_alone(library):
    rng, known = np.random.default_rng(8), token_store._Pieces(tokenizer_path())
    assert known.bare is not None
    parts = "on the tion er ß ö é ñ ción ÿ þ heit S ES Ö it m ll re A'S don't 's".split()
    texts = [" ".join("".join(rng.choice(parts, rng.integers(1, 7))) + rng.choice(["", ",", "...", "?!"]) for _ in range(700)) for _ in range(40)]
    check(library, known, texts)


def test_files_that_treat_letters_otherwise_have_no_bare_model(tmp_path, library):
    from tokenizers import normalizers

    other = Tokenizer.from_str(library.to_str())
    other.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()])
    other.save(path := str(tmp_path / "other.json"))
    assert token_store._Pieces(path).bare is None
