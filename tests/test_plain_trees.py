"""Stored trees: plain records by one pattern, all others as literals."""

from inferna.sources import trees_text


def test_plain_trees_are_read_without_the_parser(monkeypatch):
    record = "{'id': 1, 'text': 'None', 'lemma': \"it's\", 'pos': None, 'head': -1, 'deprel': ''}"
    odd = ["[" + record + ", ]", "[" + record + "], [" + record + "]", "[" + record, "[" + record.replace("'None'", "'a\\n'") + "]",
           "[" + record.replace("1, 't", "99999999999999, 't") + "]", "[" + record.replace("'None'", "'\0'") + "]", " [" + record + "]", None, "[]", "x"]
    sizes, fields = trees_text.columns_of(odd)
    want = [trees_text.edges_of(t) for t in odd]
    assert sizes == [len(w) for w in want]
    assert list(zip(*fields)) == [tuple(e[n] for n in trees_text.ORDER) for w in want for e in w]
    monkeypatch.setattr(trees_text, "edges_of", None)
    assert trees_text.columns_of(["[" + ", ".join([record] * 3) + "]"]) == ([3], [[1] * 3, ["None"] * 3, ["it's"] * 3, [None] * 3, [-1] * 3, [""] * 3])
