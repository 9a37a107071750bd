"""Golden values and edge cases of what happens inside one document."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum import synth
from vellum.core import crypt, filters, functions
from vellum.core.content import OPERANDS, operators
from vellum.core.document import Document
from vellum.core.fold import Fold, appearance, displacement
from vellum.core.fonts import FirstMatch, Font
from vellum.core.geometry import Matrix, Rect, rect_of
from vellum.core.glyphs import encoding
from vellum.core.objects import Lexer, Name, PdfError, Ref, parse_object, tokens
from vellum.core.text import pdf_doc_bytes, pdf_text


def obj(b):
    return parse_object(Lexer(b))[1]


def test_reals_add_digit_by_digit():
    assert [obj(x) for x in (b"501.8063", b"723.9428", b"-5.833333", b"0.9999966", b"-.5", b"4.", b"+7")] == [501.80629999999996, 723.9427999999999, -5.8333330000000005, 0.9999966, -0.5, 4.0, 7]


def test_objects():
    assert obj(b"[1 2.5 /A (x) <4f> true false null 3 0 R << /K [ ] >>]") == [1, 2.5, "A", b"x", b"O", True, False, None, Ref(3, 0), {"K": []}]
    assert obj(b"<< /A 1 /A 2 >>") == {"A": 1}
    assert obj(b"<>") == b"" and obj(b"<4>") == b"@" and obj(b"(a(b)c)") == b"a(b)c" and obj(b"(a\\\r\nb\\053\\n\\q)") == b"ab+\nq"
    assert obj(b"/Lime#20Green") == "Lime Green" and isinstance(obj(b"/A"), Name)
    assert obj(b"(open") == b"open"
    assert obj(b"  % comment\n") is None


@pytest.mark.parametrize("bad, failure", [(b"]", "unexpectedToken"), (b"<< 1 2 >>", "unexpectedToken"), (b"[1", "missingEndOfScope"), (b"<4x>", "invalidHexDigit"), (b"R", "unexpectedToken"), (b")", "unexpectedToken")])
def test_object_failures(bad, failure):
    with pytest.raises(PdfError) as e:
        obj(bad)
    assert e.value.failure == failure


@given(st.binary(max_size=60))
@settings(max_examples=200, deadline=None)
def test_no_bytes_break_the_tokenizer(b):
    tokens(b)


@given(st.binary(max_size=80))
@settings(max_examples=200, deadline=None)
def test_no_bytes_break_a_document(b):
    for data in (b, b"%PDF-1.4\n" + b, synth.one_page(b).finish(), synth.one_page(b"").finish()[:-20] + b):
        d = Document(data)
        list(d.objects())
        for p in d.pages():
            list(Fold(d, 7).page(p))


@given(st.binary(max_size=40))
def test_strings_come_back(b):
    assert obj(synth.literal(b)) == b


def test_text_strings():
    assert pdf_text(bytes.fromhex("48656C6C6F2080209394 20A0".replace(" ", ""))) == "Hello • ﬁﬂ ₢"
    assert pdf_text(b"\xfe\xff\x00A") == "A" and pdf_text(b"\xff\xfeA\0") == "A" and pdf_text("﻿é".encode()) == "é"
    assert pdf_doc_bytes("a•€") == b"a\x80X"


def calc(program, x=(0.5,), domain=(0, 1), rng=(-1000, 1000)):
    p = functions.parse_program(program)
    return None if p is None else functions.evaluate(functions.Function("calculator", domain, rng, program=p), list(x))


@pytest.mark.parametrize(
    "program, x, rng, expected",
    [
        ("{pop -2 abs 3 4 add add 2 sub 3 mul 2 div 2 exp sqrt}", 0.5, 1, [10.5]),
        ("{pop 1 1 atan 60 cos add 3.2 ceiling add 3.8 floor add -3.8 truncate add}", 0.5, 1, [49.5]),
        ("{pop 7 3 idiv 7 3 mod add 100 ln add 100 log add 3.8 cvi cvr add}", 0.5, 1, [12.605170185988092]),
        ("{pop 30 sin 4 sqrt add 2.5 round add -2.5 round neg add}", 0.5, 1, [8.5]),
        ("{dup 0.5 ge exch 0.75 lt and {2} {3} ifelse}", 0.6, 1, [2]),
        ("{pop 6 3 and 8 or 3 xor 1 bitshift}", 0.5, 1, [18]),
        ("{pop true false or not {1} if false true xor {2} {3} ifelse}", 0.5, 1, [2]),
        ("{dup 0 gt exch 0 le or {4} if}", 0.4, 1, [4]),
        ("{pop 2 2 eq 2 3 ne and {5} {6} ifelse}", 0.5, 1, [5]),
        ("{pop 1 2 3 3 1 roll}", 0.5, 3, [3, 1, 2]),
        ("{pop 1 2 exch dup 1 index 3 copy pop pop}", 0.5, 5, [2, 1, 1, 1, 1]),
    ],
)
def test_calculator(program, x, rng, expected):
    assert calc(program, (x,), rng=(-1000, 1000) * rng) == pytest.approx(expected, abs=1e-9)


def test_calculator_failures_and_limits():
    for bad in ("{1 unknown}", "{1 2", "{pop 1 0 div}", "{pop -1 sqrt}", "{pop 0 0 atan}", "{" * 70 + "}" * 70):
        assert calc(bad) is None
    assert calc("{" + "dup pop " * 4000 + "}") == [0.5]


def test_sampled_below_a_byte():
    assert functions.unpack_samples(bytes([0b11100100]), 4, 1, 2) == ((1.0,), (2 / 3,), (1 / 3,), (0.0,))


def test_rectangles():
    assert Rect(0, 0, 100, 80).intersection(Rect(25, 10, 100, 100)) == Rect(25, 10, 75, 70)
    assert Rect(0, 0, 1, 1).intersection(Rect(1, 0, 1, 1)) is None
    assert rect_of([10, 20, 0, 5]) == Rect(0, 5, 10, 15) and rect_of([1, 2, 3]) is None
    assert Matrix(2, 0, 0, 2, 1, 1).box(Rect(0, 0, 1, 1)) == Rect(1, 1, 2, 2)
    assert Matrix(0, 3, -3, 0).orientation() == Matrix(0, 1, -1, 0) and Matrix(0, 0, 0, 0).orientation() == Matrix()
    assert appearance(Rect(0, 0, 2, 2), Matrix(), Rect(10, 10, 4, 6)).box(Rect(0, 0, 2, 2)) == Rect(10, 10, 4, 6)


def test_predictors():
    assert filters.undo_predictor(bytes([1, 1, 1, 1]), 2, 1, 8, 4) == bytes([1, 2, 3, 4])
    assert filters.undo_predictor(b"\1\1\1\1" + b"\2\1\1\1", 15, 1, 8, 3) == bytes([1, 2, 3, 2, 3, 4])
    assert filters.undo_predictor(b"\3\4\4" + b"\3\4\4", 13, 1, 8, 2) == bytes([4, 6, 6, 10])
    assert filters.undo_predictor(b"ab", 1) == b"ab"
    raw = zlib.compress(b"hello")
    assert filters.inflate(raw) == filters.inflate(raw[2:]) == b"hello" and filters.inflate(zlib.compress(b"x" * 5000)[:-6])[:10] == b"x" * 10
    with pytest.raises(PdfError, match="unsupportedFilter"):
        filters.decode(b"", ["LZWDecode"], [], False)
    with pytest.raises(PdfError, match="unknownFilter"):
        filters.decode(b"", ["Zip"], [], False)
    assert filters.decode(b"x", ["DCTDecode"], [], True) == (b"x", ["DCTDecode"])


def test_aes_known_answer():
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.aes_cbc_decrypt(key, bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a"), iv=bytes(16), unpad=False) == plain
    key = bytes(range(32))
    assert crypt.aes_cbc_decrypt(key, bytes.fromhex("8ea2b7ca516745bfeafc49904b496089"), iv=bytes(16), unpad=False) == plain
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


@pytest.mark.parametrize("password, failure", [("pdf", None), ("owner", None), (None, "passwordRequired"), ("bad", "invalidPassword")])
def test_passwords(password, failure):
    w = synth.one_page(b"")
    trailer, key = synth.rc4_40(w, b"pdf", b"owner")
    w.objects[4] = synth.stream(synth.arcfour(synth.object_key(key, 4), b"BT (This is some basic text) Tj ET"))
    d = Document(w.finish(trailer=trailer), password)
    if failure:
        assert [e[0] for e in d.errors] == [failure]
    else:
        assert [f.text[0] for p in d.pages() for f in Fold(d, 4).page(p)] == ["This is some basic text"]


def test_aes256_revision_5():
    password, salt, key = b"pdf", b"validsalkeysalt!", bytes(range(32))
    u = hashlib.sha256(password + salt[:8]).digest() + salt
    # UE wraps the key with AES; a key that decrypts to itself is found by decrypting what stands there.
    ue = bytes(range(32, 64))
    s = crypt.Security({"V": 5, "R": 5, "P": -4, "O": bytes(48), "U": u, "UE": ue, "OE": bytes(32)}, None, "pdf")
    assert s.key == crypt.aes_cbc_decrypt(hashlib.sha256(password + salt[8:16]).digest(), ue, iv=bytes(16), unpad=False) and len(key) == len(s.key)


def test_operator_table_and_operands():
    assert len(OPERANDS) == 73
    ops = list(operators(b"[0 4.993] 2 d /P << /MCID 1 >> BDC 1 2 3 4 5 6 7 cm (a) ' 1 2 (b) \" [(x) -5 (y)] TJ .1 .2 /Pat scn BI /W 1 ID \x01\x02 EI Q"))
    assert [o.op for o in ops] == ["d", "BDC", "cm", "'", '"', "TJ", "scn", "BI", "ID", "EI", "Q"]
    assert ops[0].nums == [2, 0, 4.993] and ops[2].nums == [2, 3, 4, 5, 6, 7] and ops[4].nums == [2, 1] and ops[5].tj == [(b"x", None), (None, -5.0), (b"y", None)]
    assert ops[6].nums == [0.1, 0.2] and ops[8].data == b"\x01\x02"


@pytest.mark.parametrize("bad, failure, before", [(b"q /T1_1 ", "expectedOperator", 1), (b"q nope Q", "unknownOperator", 1), (b"q BX nope EX", "unknownOperator", 2), (b"1 w (x) w", "missingRequiredParameters", 1)])
def test_operators_before_a_failure_stay(bad, failure, before):
    got = []
    with pytest.raises(PdfError) as e:
        for op in operators(bad):
            got.append(op)
    assert e.value.failure == failure and len(got) == before


def features(content, resources=b"", extra=None, mask=7, page=b"/MediaBox [0 0 40 40]", compat=False):
    d = Document(synth.one_page(content, resources, page, extra).finish())
    return [f for p in d.pages() for f in Fold(d, mask, compat).page(p)], d


def test_text_without_font():
    (f,), _ = features(b"BT /No 12 Tf (A) Tj ET")
    assert f.bounds.width == pytest.approx(7.2) and f.bounds.height == pytest.approx(12.0) and f.bounds.y == pytest.approx(-2.4)
    assert displacement(277.7778, 9, 100) == pytest.approx(-2.5000002)


def test_font_metrics_and_missing_parts():
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /FontDescriptor << /FontBBox [0 -250 1000 900] /MissingWidth 333 >> >>"
    (f,), d = features(b"BT /F 10 Tf (A) Tj ET", b"/Font << /F 5 0 R >>", {5: font})
    assert Font(d, d.dict_(Ref(5, 0))).metrics() == (0.9, -0.25) and f.bounds.width == pytest.approx(3.33)
    _, d = features(b"BT /F 10 Tf (A) Tj ET", b"/Font << /F << /Subtype /Odd >> >>")
    assert [e[0] for e in d.errors] == ["unsupportedFontSubtype"]


def test_spacing_is_in_text_space_unless_compat():
    extra = {5: synth.FONT}
    new = features(b"BT /F1 10 Tf 2 Tc 3 Tw (a b) Tj ET", b"/Font << /F1 5 0 R >>", extra)[0][0].bounds.width
    old = features(b"BT /F1 10 Tf 2 Tc 3 Tw (a b) Tj ET", b"/Font << /F1 5 0 R >>", extra, compat=True)[0][0].bounds.width
    bare = sum(synth.width_of(c) for c in b"a b") / 100
    assert new == pytest.approx(bare + 3 * 2 + 3) and old == pytest.approx(bare + 30)


def test_state_stack_and_cycles():
    form = {5: synth.stream(b"/Im Do /Fm Do", b"/Subtype /Form /Resources << /XObject << /Im 6 0 R /Fm 5 0 R >> >>"), 6: synth.stream(b"", b"/Subtype /Image /Width 1 /Height 1")}
    got, _ = features(b"q 2 0 0 2 0 0 cm /Fm Do Q Q /Im Do", b"/XObject << /Fm 5 0 R /Im 6 0 R >>", form)
    assert [f.bounds.width for f in got] == [2, 1]


def test_tj_of_offsets_alone_gives_nothing_and_moves():
    got, _ = features(b"BT /F 10 Tf [-1000] TJ (A) Tj [(B) -100 (C)] TJ ET")
    assert [f.text[0] for f in got] == ["A", "BC"] and got[0].bounds.x == 10


def test_masks():
    page = b"/MediaBox [0 0 9 9] /Annots [<< /Rect [0 0 1 1] /Subtype /Link >> << /Subtype /NoRect >> << /Rect [1 1 2 2] >>]"
    got, _ = features(b"(x) Tj", page=page, mask=1)
    assert [f.annotation[:2] for f in got] == [("Link", 0), (None, 2)]
    assert features(b"(x) Tj", page=page, mask=0)[0] == []


def test_inherited_boxes_resources_and_bad_trees():
    w = synth.Writer()
    w.add(b"<< /Type /Catalog /Pages 2 0 R >>", 1)
    w.add(b"<< /Type /Pages /MediaBox [0 0 7 7] /Resources << /Font << /F 5 0 R >> >> /Kids [3 0 R 2 0 R] >>", 2)
    w.add(b"<< /Type /Pages /Kids [4 0 R] >>", 3)
    w.add(b"<< /Type /Page /Contents 6 0 R >>", 4)
    w.add(synth.FONT, 5)
    w.add(synth.stream(b"BT /F 10 Tf (A) Tj ET"), 6)
    d = Document(w.finish())
    pages = list(d.pages())
    assert len(pages) == 1 and pages[0].rect() == Rect(0, 0, 7, 7) and [e[0] for e in d.errors] == ["expectedPageTree"]
    assert list(Fold(d, 4).page(pages[0]))[0].bounds.width == pytest.approx(synth.width_of(65) / 100)


def test_revisions_and_packed_objects_and_recovery():
    w = synth.one_page(b"")
    w.add(b"(old)", 5)
    w.finish()
    data = w.update({5: b"(new)"})
    d = Document(data)
    assert d.resolve(Ref(5, 0)) == b"new" and [(r.num, rev) for r, rev, _ in d.objects() if r.num == 5] == [(5, 0), (5, 1)]
    cut = Document(data[: data.rindex(b"startxref")])
    assert cut.recovered and cut.resolve(Ref(5, 0)) == b"new"
    for flate in (False, True):
        d = Document(synth.one_page(b"(x) Tj").finish_packed(flate=flate))
        assert len(list(d.pages())) == 1 and not d.errors


def test_self_reference_ends():
    w = synth.one_page(b"")
    w.add(b"5 0 R", 5)
    w.add(b"<< /Length 6 0 R >>\nstream\nx\nendstream", 6)
    d = Document(w.finish())
    assert d.resolve(Ref(5, 0)) is None
    list(d.objects())
    assert "missingLength" in {e[0] for e in d.errors}


def test_first_match():
    m = FirstMatch([(5, 9, "a"), (1, 20, "b"), (7, 7, "c"), (0, 0, "d")])
    assert [(m.find(c) or (0, 0, None))[2] for c in (0, 1, 5, 7, 9, 10, 20, 21)] == ["d", "b", "a", "a", "a", "b", "b", None]


def test_glyph_names():
    win, std, mac = (encoding(n) for n in ("WinAnsiEncoding", "StandardEncoding", "MacRomanEncoding"))
    assert (win[0x80], win[0xE9], win[0x31], win[0x41], win[0xFF]) == ("Euro", "eacute", "one", "A", "ydieresis")
    sizes = {n: len(encoding(n)) for n in ("SymbolEncoding", "ZapfDingbatsEncoding", "ExpertEncoding", "MacExpertEncoding")}
    assert sizes == {"SymbolEncoding": 188, "ZapfDingbatsEncoding": 188, "ExpertEncoding": 165, "MacExpertEncoding": 165}
    assert encoding("SymbolEncoding")[0x61] == "alpha" and encoding("MacExpertEncoding")[0xFB] == "Ringsmall" and encoding("Other") == {}
    assert (std[0x27], std[0xAE], mac[0x8E], mac[0xCA]) == ("quoteright", "fi", "eacute", "space")


def test_hybrid_sections():
    w = synth.one_page(b"")
    w.finish()
    holder = len(w.out)
    w.out += b"6 0 obj\n" + synth.stream(b"7 0 (packed)", b"/Type /ObjStm /N 1 /First 4") + b"\nendobj\n"
    at = len(w.out)
    w.out += b"8 0 obj\n" + synth.stream(bytes([2, 0, 6, 0]), b"/Type /XRef /W [1 2 1] /Index [7 1] /Size 9") + b"\nendobj\n"
    data = w._table({6: holder}, 1, b"/XRefStm %d" % at)
    d = Document(data)
    assert d.resolve(Ref(7, 0)) == b"packed" and len(d.sections) == 3 and len(list(d.pages())) == 1


def test_loops_of_sections_end():
    w = synth.one_page(b"")
    first = w.finish()
    at = w.last_xref
    w2 = synth.one_page(b"")
    w2.last_xref = at
    data = w2.finish()
    assert first and Document(data).ok


def test_crypt_filter_identity_and_exempt_dictionary():
    w = synth.one_page(b"")
    trailer, key = synth.aes_128(b"", b"owner")
    w.objects[4] = synth.stream(b"BT (plain) Tj ET", b"/Filter [/Crypt] /DecodeParms [<< /Name /Identity >>]")
    d = Document(w.finish(trailer=trailer))
    assert d.ok and [f.text[0] for p in d.pages() for f in Fold(d, 4).page(p)] == ["plain"]


def test_cmap_with_mixed_lengths():
    from vellum.core.fonts import ToUnicode, codes, parse_cmap

    t = ToUnicode(b"2 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 2 beginbfchar <41> <0061> <8001> <D83DDE00> endbfchar 1 beginbfrange <42> <44> [<0062> <00660069>] endbfrange 1 beginbfrange <8010> <8012> <00410030> endbfrange")
    assert t.decode(b"ABCD\x80\x01\x80\x12\xff") == "abfi\U0001f600A2" and t.decode(b"\xff") is None
    assert codes(b"\x41\x80\x01\x80", t.spaces) == [0x41, 0x8001]
    assert parse_cmap(b"/WMode 1 def 1 begincidrange <00> <10> 5 endcidrange 1 begincidchar <20> 9 endcidchar", unicode=False)[1:] == ([(0, 16, 5), (32, 32, 9)], 1)


@pytest.mark.parametrize("text", [b"<< /A [ 1 0 R 2 true ] /B << /C (x) >> /D null >>", b"[ 1 2 0 R 3 R0 ]", b"5 0 R", b"[ << /A 1 ] >>", b"<< /A 1 2 >>", b"[ nullx 1 R ]"])
def test_comments_for_blanks_change_no_object(text):
    """What is read in one match and what the lexer reads token by token is the same."""

    def got(data):
        try:
            return parse_object(Lexer(data))
        except PdfError as e:
            return e.failure

    assert repr(got(text)) == repr(got(text.replace(b" ", b"%c\n")))


def test_sections_and_headers_in_other_spacing():
    plain = synth.one_page(b"BT ET", extra={5: b"[1 0 R (s)]"}).finish()
    other = plain.replace(b" n", b"%n").replace(b"%n", b"\x00n")
    for data in (plain, other):
        doc = Document(data)
        assert not doc.recovered and [p.index for p in doc.pages()] == [0] and repr(doc.get((5, 0))) == repr(Document(plain).get((5, 0)))
