"""The bounded dictionary of words: what is in use stays, and ids are the library's."""

from collections import Counter

from tokenizers import Tokenizer

from spanforge.llm import tokens


def test_words_in_use_are_encoded_once():
    enc, asked = tokens.WordEncoder(tokens.default_path(), most_words=40), Counter()
    word = enc._word
    enc._word = lambda w: asked.update([w]) or word(w)
    for i in range(300):
        enc.encode(f"common stone new{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}")
    assert asked["common"] == asked["stone"] == 1
    assert len(enc.words) + len(enc.before) < 60


def test_cases_signs_and_scripts():
    whole = Tokenizer.from_file(tokens.default_path())
    texts = ["Stone, STONE. stone! (stone) stone1 1stone 12 3. ...", "Éole, éole; ÀÉÎ Ⱥ1x Ⱥ ⱥa ſ K ß ẞ ǅ.", "éa é́ <s> <S> can't I'M a'b", "", "\n\n a  b c\td", "a.b,c -- -x- x- ñ9 9ñ ñ-", "日本 абв1, абв"]
    for most in (3, 700_000):
        enc = tokens.WordEncoder(tokens.default_path(), most_words=most)
        for text in texts * 2:
            assert enc.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_cases_and_signs_at_the_end_take_no_place():
    whole = Tokenizer.from_file(tokens.default_path())
    enc = tokens.WordEncoder(tokens.default_path())
    texts = ["Stone, STONE. stone\nStone. Éole, ÉOLE. éole, x", "a., b,. c ., d , e. . f _, g, _. 1, 2. é., ²,  ª. ", ", . ,", ". ", "Ⱥ, ⱥ. İ, i. ſ, K. can't, I'M. <s>, <S>. Ok, ok."]
    for text in texts * 2:
        assert enc.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text
    assert not {"Stone", "Stone,", "STONE.", "stone,", "Éole,", "ÉOLE."} & set(enc.words)
