import contextlib
import io
import random
import re

from pyspark.sql import functions as F

from provenio.operators import structure as S
from provenio.sources import files as X

PAGES = "doc_id string, page_no int, text string"


def test_headers_and_footers(spark):
    def text(i):
        body = "\n".join(f"texto {chr(97 + i)}{chr(97 + n)} do contrato" for n in range(12))
        return f"Seguradora Exemplo S.A.\nProcesso 15414.{i}\n{body}\nPágina {i} de 6"

    pages = spark.createDataFrame([("d", i, text(i)) for i in range(1, 7)] + [("short", i, text(i)) for i in range(1, 4)], PAGES)
    kept = S.strip_headers(S.page_lines(pages)).groupBy("doc_id", "page_no").count()
    counts = {(r[0], r[1]): r[2] for r in kept.collect()}
    assert counts[("d", 1)] == 15 and all(counts[("d", i)] == 12 for i in range(2, 7)) and counts[("short", 2)] == 15


TEXT = [
    "Texto de abertura", "4. DEFINIÇÕES", "Corpo um", "CLÁUSULA 10ª - LIMITE MÁXIMO DE GARANTIA", "Corpo dois", "COBERTURA ADICIONAL DE MULTAS E",
    "PENALIDADES CONTRATUAIS", "Corpo três", "9.1. Prazo Adicional", "3.1. O presente seguro é contratado a primeiro risco absoluto.",
]


def test_clauses_and_blocks(spark):
    pages = spark.createDataFrame([("d", 1, "\n".join(TEXT[:7])), ("d", 2, "\n".join(TEXT[7:]))], PAGES)
    clauses = S.clauses(S.with_sections(S.with_titles(S.page_lines(pages))))
    rows = clauses.orderBy("clause_no").collect()
    assert [(r.number, r.title) for r in rows] == [
        (None, "PREÂMBULO"), ("4", "DEFINIÇÕES"), ("10", TEXT[3]), (None, "COBERTURA ADICIONAL DE MULTAS E PENALIDADES CONTRATUAIS"), ("9.1", "Prazo Adicional"),
    ]
    assert rows[3].page_start == 1 and rows[3].page_end == 2 and rows[3].text == "Corpo três" and rows[4].text == TEXT[9]
    blocks = S.blocks(clauses, max_chars=10).orderBy("clause_no", "block_no").collect()
    assert blocks[0].text == "[pág. 1]\nTexto de abertura" and len(blocks) == 5


def brute_blocks(lines, pages, limit):
    out, now, size, page = [], [], 0, None
    for line, at in zip(lines, pages, strict=True):
        if now and size + len(line) > limit:
            out, now, size, page = [*out, "\n".join(now)], [], 0, None
        if at != page:
            now, page = [*now, f"[pág. {at}]"], at
        now, size = [*now, line], size + len(line) + 1
    return [*out, "\n".join(now)]


def test_blocks_against_brute_force(spark):
    lines, pages = [f"linha {i} " + "x" * (i * 7 % 31) for i in range(40)], [1 + i // 13 for i in range(40)]
    clause = spark.createDataFrame([("d", 0, "1", "T", 1, "\n".join(lines), pages), ("d", 1, None, "V", 3, "", [])], "doc_id string, clause_no int, number string, title string, page_start int, text string, page_map array<int>")
    rows = S.blocks(clause, 120).orderBy("clause_no", "block_no").collect()
    assert [r.text for r in rows] == [*brute_blocks(lines, pages, 120), "[pág. 3]"]


def test_index_page_has_no_titles(spark):
    text = "\n".join(f"{i}. CLÁUSULA DE EXEMPLO {'.' * 20} {i}" for i in range(1, 9))
    pages = spark.createDataFrame([("d", 1, text)], PAGES)
    assert S.with_titles(S.page_lines(pages)).where("title is not null").count() == 0
    assert S.index_pages(S.page_lines(pages)).count() == 1


def test_sections(spark):
    text = "CONDIÇÕES GERAIS DO SEGURO\na\nCONDIÇÕES ESPECIAIS\n\n1. OBJETO DO SEGURO\nb\nConforme condições gerais"
    got = S.with_sections(S.with_titles(S.page_lines(spark.createDataFrame([("d", 1, text)], PAGES)))).orderBy("line_no").collect()
    assert [r.section for r in got] == ["condicoes_gerais"] * 2 + ["condicoes_especiais"] * 5


def test_intake(spark):
    rows = [(b"%PDF-1.7 x", None), (b"junk %PDF-1.4", None), (b"\x89PNG\r\n\x1a\n..", None), (b"\xff\xd8\xff..", None), (b"", "empty"), (None, "empty"), (b"GIF89a", "unknown_kind"), (b"%PDF-" + b"x" * 99, "too_large")]
    files = spark.createDataFrame(rows, "content binary, want string")
    got = files.select(X.refusal(F.col("content"), max_bytes=50).alias("r"), "want", X.kind_of(F.col("content")).alias("k")).collect()
    assert [r.r for r in got] == [r.want for r in got] and [r.k for r in got[:4]] == ["pdf", "pdf", "png", "jpg"]
    names = spark.createDataFrame([("a/b:c?.pdf",), ("???",), ("é" * 200,)], "n string").select(X.safe_name(F.col("n"))).collect()
    assert names[0][0] == "abc.pdf" and names[1][0] == "documento" and len(names[2][0]) == 120


def test_ocr_lines_follow_the_first_box(spark):
    boxes = [("d", 1, 50.0, 10.0, 10.0, "b", 0.9), ("d", 1, 0.0, 14.0, 10.0, "a", 0.7), ("d", 1, 0.0, 17.0, 10.0, "c", 0.8)]
    got = X.recognised_lines(spark.createDataFrame(boxes, "doc_id string, page_no int, x double, y double, height double, text string, score double")).first()
    assert got.text == "a b\nc" and abs(got.ocr_conf - 0.8) < 1e-9


def brute_strip(lines):
    """One pass over rows (doc_id, page_no, line_no, raw) as it is described."""
    out, docs = [], {}
    for x in lines:
        docs.setdefault(x[0], {}).setdefault(x[1], []).append(x)
    key = lambda raw: re.sub("[0-9]+", "#", re.sub(r"\s+", " ", raw.strip(" ").lower()))
    for pages in docs.values():
        edges, on = set(), {}
        for no, own in pages.items():
            filled = sorted((x for x in own if x[3].strip(" ")), key=lambda x: x[2])
            edges |= {*filled[: S.HEAD_LINES], *filled[-S.FOOT_LINES :]}
            for x in edges & {*filled}:
                on.setdefault(key(x[3]), set()).add(no)
        again = {k for k, p in on.items() if len(p) >= 0.5 * len(pages) and k != "#"}
        out += [x for own in pages.values() for x in own if not (x in edges and x[1] > 1 and len(pages) >= S.LEAST_PAGES and (key(x[3]) in again or re.search(S.PAGE_NUMBER, x[3])))]
    return out


def test_stripping_against_brute_force_moves_lines_once(spark):
    rng = random.Random(7)
    some = ["Cabeçalho A", "cabeçalho  a", "Rodapé 12", "pág. 3 de 9", "7", "", "  ", "x", "ab c", *[f"texto {chr(97 + i)}" for i in range(20)]]
    lines = [(d, p, i, rng.choice(some[: rng.choice((9, 30))])) for d in range(40) for p in range(1, rng.randint(2, 9)) for i in range(rng.randint(1, 25))]
    frame = spark.createDataFrame([*lines, (None, 1, 0, "x")], "doc_id int, page_no int, line_no int, raw string")
    kept = S.strip_headers(frame)
    want = brute_strip(brute_strip(lines))
    assert sorted(map(tuple, kept.collect())) == sorted(want) and len(want) < len(lines)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        S.strip_headers(frame).explain()
    assert len(re.findall(r"[+:]- Exchange ", plan.getvalue())) == 1
