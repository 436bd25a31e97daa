"""Links behind a long secret with another finding inside it."""

from plumbline.llm import secrets


def test_identifier_behind_a_nested_finding():
    text = "password=" + "0123456789abcdef" * 2 + "Z" * 400
    text += " " * 70 + "client_id=abc"
    base = secrets.base_spans(text)
    assert [k for _, k, _ in base] == [0, 2]
    assert (text.index("client_id"), 3, len(text)) in secrets.linked_spans(text, base, 300)
