"""What layout does once for each text or group."""

import pytest

from tessera.functions import layout, lexer


@pytest.mark.parametrize("text", ["select 'a' || E'\\'' -- x", "a $t$ b $t$ /* c /* d */ */ é", "\\echo a  \nselect $1, :'b', U&'x'"])
def test_pieces_are_the_words_of_the_lexer(text):
    assert [x for _, x in lexer.pieces(text)] == [t.text for t in lexer.lex(text)]


def test_a_group_is_written_flat_once(monkeypatch):
    calls = []
    monkeypatch.setattr(layout, "spaced", lambda *a, was=layout.spaced: calls.append(1) or was(*a))
    depth = 40
    items = layout.tree(lexer.lex("(" * depth + "a + b" + ")" * depth))
    while isinstance(items[0], layout.Group):
        assert layout.flat(items).count("(") == depth
        items, depth = items[0].items, depth - 1
    assert len(calls) < 10 * 40


def test_words_of_tokens_follow_their_text():
    t = lexer.Token("dollar_string", "$$A$$")
    t.say("$$B$$")
    assert (t.text, t.lower, t.word) == ("$$B$$", "$$b$$", "") and lexer.Token("keyword", "FROM").word == "from"
