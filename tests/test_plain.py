"""What most files have is read in few steps, and as the reader of tokens has it."""

import random

import pytest

from vellum import synth
from vellum.core import content, objects
from vellum.core.document import Document


def told(read, data):
    out = []
    try:
        for op in read(data):
            out.append(repr(op))
    except objects.PdfError as e:
        out.append((e.failure, e.start, e.end))
    return out


@pytest.mark.parametrize("tail", [b"", b" 3", b" 1 2 re", b" true q", b" R", b" 1 what", b" 1-2 w", b" (a) Tj q", b" % x\n q", b" 1 J 2 w", b"\x0bq", b" BI /W 1 ID x EI q", b" 9999999999999999999 w", b" /N gs 1 w"])
def test_plain_contents_are_what_tokens_say(tail):
    """Errors and their places, too."""
    r = random.Random(7)
    numbers = [b"1", b"-0", b"+5", b".5", b"5.", b".", b"-.25", b"501.8063", b"0.1234567890123456789012345678901234567890"]
    for _ in range(40):
        body = []
        for _ in range(r.randrange(6)):
            op = r.choice(["q", "Q", "re", "rg", "f*", "m", "cm", "w"])
            body += [*(r.choice(numbers) for _ in range(len(content.OPERANDS[op]) + r.randrange(2))), op.encode()]
        data = r.choice([b"", b" \n"]) + r.choice([b" ", b"\r\n", b"\t "]).join(body) + tail
        assert told(content.operators, data) == told(content._operators, data)


def test_plain_contents_need_no_tokens(monkeypatch):
    """F8, F9: of numbers and words alone, one look at each."""

    def none(*_):
        raise AssertionError("read by tokens")

    monkeypatch.setattr(content, "Lexer", none)
    assert [op.op for op in content.operators(b"q\n0.05 0 .02 rg 17 21168.23 1 1 re f\nQ")] == ["q", "rg", "re", "f", "Q"]


def test_dictionaries_that_files_repeat_are_read_once(monkeypatch):
    """F7, F8, F9: and what a reader does with its own does not reach the next file's."""
    parsed = []
    own = objects._parse
    monkeypatch.setattr(objects, "_parse", lambda lex, decrypt: parsed.append(lex.pos) or own(lex, decrypt))
    monkeypatch.setattr(objects, "_known", {})
    data = synth.one_page(b"q Q", b"/ColorSpace << /A [/ICCBased 9 0 R] >>").finish()
    first = [(r, repr(x)) for r, _, x in Document(data).objects() if r.num < 4]
    n = len(parsed)
    again = Document(data)
    assert [(r, repr(x)) for r, _, x in again.objects() if r.num < 4] == first and len(first) == 3 and len(parsed) == n > 0
    again.trailer["Root"] = None
    again.get(objects.Ref(1, 0))["Pages"] = None
    assert [p.index for p in Document(data).pages()] == [0]


@pytest.mark.parametrize("text", [b"<< /A << /B << /C 1 >> >> >>", b"<< /A [ 1 >>", b"<< /A 1 >", b"<< /A >>", b"<</A<</B 1>>>>", b"<< /A (x) >>", b"<< /A <41> >>", b"<< /A 1 % >>\n>>", b"<< /A 1 /A 2 >>", b"<< 1 2 >>"])
def test_repeated_dictionaries_are_what_tokens_say(text):
    def told_of(read):
        lex = objects.Lexer(text + b" endobj")
        try:
            return repr(read(lex)), lex.pos
        except objects.PdfError as e:
            return e.failure, e.start, e.end

    want = told_of(lambda lex: objects._parse(lex, None))
    assert told_of(objects.parse_object) == told_of(objects.parse_object) == want


def test_known_dictionaries_are_bounded(monkeypatch):
    monkeypatch.setattr(objects, "_known", {})
    for k in range(objects.KNOWN + 10):
        objects.parse_object(objects.Lexer(b"<< /A %d >>" % k))
    objects.parse_object(objects.Lexer(b"<< /A [" + b"1 " * objects.KNOWN_BYTES + b"] >>"))
    assert 0 < len(objects._known) <= objects.KNOWN and max(map(len, objects._known)) <= objects.KNOWN_BYTES


def test_records():
    import pyarrow as pa

    from vellum.queries import records

    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.string())]))
    rows = [[{"a": 1, "b": "x"}, {"a": None, "b": None}], [], [{"a": 3, "b": "z"}], [{"a": 4, "b": "w"}]]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, None]), pa.array(rows, kind)], names=["k", "items"])
    for part in (batch, batch.slice(1, 2), batch.slice(2), batch.slice(0, 0)):
        assert records(part) == part.to_pylist()
    odd = pa.RecordBatch.from_arrays([pa.array([None, [None, {"a": 1, "b": "x"}]], kind)], names=["items"])
    assert records(odd) == odd.to_pylist()
