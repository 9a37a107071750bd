"""Table and scalar functions for SQL: pdf_tokens, pdf_objects, pdf_xref, pdf_operators, pdf_features; pdf_text, pdf_function_eval, pdf_decode_stream."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def pdf_text_sql() -> str:
    """The Column pdf_text of vellum.functions.text as a SQL function, so that it stays in the JVM."""
    from vellum.functions.text import _FROM, _TO

    given, to = (f"decode(unhex('{x.encode().hex()}'), 'UTF-8')" for x in (_FROM, _TO))
    return f"""CREATE OR REPLACE TEMPORARY FUNCTION pdf_text(b BINARY) RETURNS STRING RETURN CASE
      WHEN substring(b, 1, 2) = X'FEFF' THEN decode(substring(b, 3), 'UTF-16BE') WHEN substring(b, 1, 2) = X'FFFE' THEN decode(substring(b, 3), 'UTF-16LE')
      WHEN substring(b, 1, 3) = X'EFBBBF' THEN decode(substring(b, 4), 'UTF-8') ELSE translate(decode(b, 'ISO-8859-1'), {given}, {to}) END"""


def register(spark: SparkSession) -> None:
    """The table functions take a password after their other arguments; pdf_features also whether compat holds."""
    from vellum.plans.tables import _ROWS, SCHEMAS

    @F.udtf(returnType="seq int, kind string, text string, start bigint, end bigint")
    class Tokens:
        def eval(self, content: bytes):
            from vellum.core.objects import tokens

            yield from tokens(content or b"")

    spark.udtf.register("pdf_tokens", Tokens)

    def table(name: str):
        rows = _ROWS[name]

        class Rows:
            def eval(self, content: bytes, password: str = None):
                from vellum.core.document import Document

                yield from rows(Document(content or b"", password))

        return F.udtf(Rows, returnType=SCHEMAS[name])

    for sql, name in (("pdf_objects", "objects"), ("pdf_xref", "xref_entries"), ("pdf_operators", "operators"), ("pdf_page_list", "pages"), ("pdf_errors", "parse_errors")):
        spark.udtf.register(sql, table(name))

    @F.udtf(returnType=SCHEMAS["features"])
    class Features:
        def eval(self, content: bytes, mask: int, password: str = None, compat: bool = False):
            from vellum.core.document import Document

            yield from _ROWS["features"](Document(content or b"", password), mask=mask, compat=bool(compat))

    spark.udtf.register("pdf_features", Features)

    @F.pandas_udf("array<double>")
    def function_eval(program, domain, rng, inputs):
        import pandas as pd

        from vellum.core import functions as f

        out = []
        for p, d, r, x in zip(program, domain, rng, inputs, strict=True):
            parsed = f.parse_program(p) if p is not None else None
            out.append(None if parsed is None or d is None or r is None or x is None else f.evaluate(f.Function("calculator", tuple(d), tuple(r), program=parsed), list(x)))
        return pd.Series(out)

    @F.pandas_udf("binary")
    def decode_stream(data, filters, predictor, colors, bits, columns):
        import pandas as pd

        from vellum.core.filters import decode
        from vellum.core.objects import PdfError

        out = []
        for b, names, *p in zip(data, filters, predictor, colors, bits, columns, strict=True):
            try:
                keys = dict(zip(("Predictor", "Colors", "BitsPerComponent", "Columns"), map(int, p), strict=True))
                out.append(None if b is None else decode(b, list(names), [keys] * len(names), False)[0])
            except PdfError:
                out.append(None)
        return pd.Series(out)

    spark.sql(pdf_text_sql())
    spark.udf.register("pdf_function_eval", function_eval)
    spark.udf.register("pdf_decode_stream", decode_stream)
