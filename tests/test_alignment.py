"""Word alignment, lessons and quotes against plain Python."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from provenio import registry
from provenio.functions import exact as E
from provenio.functions import text as T
from provenio.operators import teach as L
from provenio.plans import proposals as P
from provenio.queries.base import document_pages
from provenio.sources import rules as declared

SF = "/root/testdata/sf0.001"
LESSON = "lesson_id string, doc_id string, field_id string, kind string, value string, quote string, page int, insurer string, created_at int"


def windows(quote, page, width):
    """All windows that begin at a word of the quote's first quarter, each aligned."""
    heads = set(quote[: max(1, len(quote) // 4)])
    for i, word in enumerate(page):
        if word in heads:
            blocks = [b for b in SequenceMatcher(None, quote, page[i : i + width], autojunk=False).get_matching_blocks() if b.size]
            yield sum(b.size for b in blocks), -i, blocks


def test_closest_window_against_all_windows():
    rng = random.Random(4)
    for _ in range(3000):
        quote, page = ([rng.choice("abcdefghij"[:n]) for _ in range(rng.randint(1, m))] for n, m in ((6, 14), (10, 60)))
        for width in (int(len(quote) * 1.5) + 2, int(len(quote) * 1.3) + 2):
            want = max(windows(quote, page, width), default=(0, 1, []), key=lambda x: x[:2])
            assert E.closest_window(quote, page, width) == (want[0], -want[1], want[2])


def test_similarity_is_that_of_quote_to_page():
    """The aligner isn't symmetric: the quote comes first."""
    rng = random.Random(5)
    differ = 0
    for _ in range(2000):
        quote, page = ([rng.choice("abc") for _ in range(n)] for n in (12, 20))
        forth, back = (sum(b.size for b in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) for x, y in ((quote, page), (page, quote)))
        differ += forth != back
    assert differ


def best(quote, page):
    q, p = quote.split(), page.split()
    if not q or not p:
        return 0.0
    return 1.0 if quote in page else max((m / len(q) for m, *_ in windows(q, p, int(len(q) * 1.5) + 2)), default=0.0)


def canon(rows, column):
    return rows.withColumn(column, T.canonical(F.col(column)))


def test_quotes_of_the_given_documents(spark):
    """token_overlap and locate_quote over the whole tables against plain loops."""
    texts = {r.doc_id: r.text for r in canon(spark.read.parquet(f"{SF}/documents.parquet"), "text").collect()}
    quotes = {r.item_id: r.text for r in canon(spark.read.parquet(f"{SF}/benchmark.parquet"), "text").collect()}
    got = {(r.doc_id, r.item_id): r.similarity for r in registry.QUERIES["token_overlap"](spark, SF).collect()}
    runs = lambda w: set(zip(w, w[1:], w[2:], w[3:], strict=False))
    by_doc, by_quote = ({i: runs(t.split()) for i, t in x.items()} for x in (texts, quotes))
    asked = {(d, q) for d, t in by_doc.items() for q, u in by_quote.items() if t & u}
    assert set(got) == asked and asked
    short = {d for d, t in texts.items() if len(t.split()) <= 2500}  # the loops below take their time
    for (d, q), s in got.items():
        assert d not in short or abs(s - best(quotes[q], texts[d])) < 1e-6
    pages = {}
    for r in canon(document_pages(spark, SF), "text").collect():
        pages.setdefault(r.doc_id, {})[r.page_no] = r.text
    located = [r for r in registry.QUERIES["locate_quote"](spark, SF).collect() if r.doc_id in short]
    assert len(located) > 2
    for r in located:
        q, own = quotes[r.item_id], pages[r.doc_id]
        both = {n: f"{own[n]} {own[n + 1]}".strip() for n in own if n + 1 in own}
        alone = {n: best(q, t) for n, t in own.items()}
        if alone.get(1, 0) >= 0.9:
            want = (1, alone[1])
        elif 1 in both and alone[2] < 0.9 and best(q, both[1]) >= 0.9:
            want = (1, best(q, both[1]))
        else:
            n = max(alone, key=lambda n: (alone[n], n == 1, -n))
            want = (n, alone[n])
            if alone[n] < 0.9 and both:
                pair = {n: best(q, t) for n, t in both.items()}
                n = max(pair, key=lambda n: (pair[n], -n))
                want = (n, pair[n]) if pair[n] > want[1] else want
        assert abs(r.similarity - want[1]) < 1e-6 and (r.found_page == want[0] or want[1] == 0), (r, want)


def lessons_and_pages(spark, lessons, pages, facts):
    docs = spark.createDataFrame(pages, "doc_id string, page_no int, text string")
    own = spark.createDataFrame(lessons, LESSON)
    known = spark.createDataFrame(facts, "doc_id string, field_id string, kind string, status string")
    made = L.reuse(own, known, docs, spark.createDataFrame([("none", "X")], "doc_id string, insurer string"))
    return {r.doc_id: r for r in made.collect()}


def test_number_is_read_from_the_wording_found(spark):
    quote = "O limite maximo de garantia e de R$ 3.000.000,00 por vigencia da cobertura"
    pages = [("a", 1, quote), ("b", 1, "O premio total e de R$ 1.000,00 pago a vista.\nO limite maximo de garantia e de R$ 5.000.000,00 por vigencia da cobertura")]
    got = lessons_and_pages(spark, [("L", "a", "f", "dinheiro", "3000000.0", quote, 1, "X", 1)], pages, [(d, "f", "dinheiro", "nao_localizado") for d in "ab"])
    assert got["a"].value == "3000000.0" and float(got["b"].value) == 5e6
    assert got["b"].quote in pages[1][2] and got["b"].quote.startswith("O limite")


TURNED = {
    "same": "Fica acordado que a franquia e que a seguradora cobre os danos em qualquer parte do mundo",
    "not": "Fica acordado que a franquia e que a seguradora nao cobre os danos em qualquer parte do mundo",
    "but": "Fica acordado que a franquia e que a seguradora cobre, salvo os danos em qualquer parte do mundo",
    "other": "Este texto trata de outra coisa e de mais nada, como se pode ler aqui",
}


def test_a_clause_turned_round_is_refused(spark):
    quote = TURNED["same"]
    pages = [("a", 1, quote), *((name, 2, text) for name, text in TURNED.items())]
    got = lessons_and_pages(spark, [("L", "a", "f", "enum", "mundial", quote, 1, "X", 1)], pages, [(d, "f", "enum", "nao_localizado") for d in ("a", *TURNED)])
    assert set(got) == {"a", "same"} and got["a"].value == got["same"].value == "mundial"


def test_a_second_negation_counts():
    """A word that the quote has once and the page twice is new."""
    quote = "garante que nao ha franquia e que a seguradora cobre todos os danos do contrato"
    page = "garante que nao ha franquia e que a seguradora nao cobre todos os danos do contrato"
    similarity, wording, changed = L.rewording(quote.split(), page.split(), page.split())
    assert similarity == 1.0 and wording == page and changed == ["nao"]


def test_own_lessons_are_checked_and_verified_facts_stay(spark):
    pages = [("a", 1, "O seguro vale em todo o territorio nacional e no exterior"), ("b", 1, "O seguro vale em todo o territorio nacional e no exterior")]
    invented = [("L", "a", "f", "enum", "x", "um trecho que ninguem escreveu em lugar nenhum", 1, "X", 1)]
    assert lessons_and_pages(spark, invented, pages, [(d, "f", "enum", "nao_localizado") for d in "ab"]) == {}
    real = [("L", "a", "f", "enum", "x", pages[0][2], 3, "X", 1)]
    got = lessons_and_pages(spark, real, pages, [("a", "f", "enum", "verificado"), ("b", "f", "enum", "verificado")])
    assert set(got) == {"a"} and got["a"].page == 1


def test_line_error_rate():
    assert E.line_error_rate("", "x") == 0 and E.line_error_rate("uma linha que ninguem leu", "") == 1
    both = "a primeira linha do texto\na segunda linha do texto"
    assert E.line_error_rate(both, "\n".join(reversed(both.split("\n")))) == 0
    assert abs(E.line_error_rate("uma linha com vinte e cinco", "uma linha cem vinte e cinco") - 1 / 27) < 1e-9


def test_accents_beyond_latin(spark):
    row = spark.createDataFrame([("Ελλάς й ½ №5 ﬁm", "abc Def-\nghi")], "a string, b string")
    assert tuple(row.select(T.canonical(F.col("a")), T.canonical(F.col("b"))).first()) == ("ελλας и 1 2 no5 fim", "abc defghi")


def test_a_bad_rule_costs_its_own_field(spark):
    rules = spark.createDataFrame([("a", "[0-9]+"), ("b", "(unclosed"), ("c", None)], "field_id string, regex string")
    kept, bad = declared.sound(rules)
    assert bad == ["(unclosed"] and {r.field_id for r in kept.collect()} == {"a", "c"}


def test_proposals(spark):
    """Contexts within a budget, once each, and answers as candidates of their kinds."""
    blocks = [("d", i, 0, f"Clausula {i}", i, ("franquia de R$ 50.000,00 " if i == 3 else "outro assunto qualquer ") * 20) for i in range(1, 6)]
    blocks = spark.createDataFrame(blocks + [("d", 3, 1, "Clausula 3", 3, blocks[2][5])], "doc_id string, clause_no int, block_no int, title string, page_start int, text string")
    groups = spark.createDataFrame([("g", 1, "franquia", 1, False), ("g", 1, "base", 2, False)], "group_id string, group_ord int, field_id string, field_ord int, from_start boolean")
    queries = spark.createDataFrame([("franquia", "franquia"), ("base", "assunto")], "field_id string, q string")
    made = P.contexts(blocks, groups, queries)
    context = made.first().context
    assert context.count("### Clausula 3") == 1 and "franquia" in context and len(context) < P.BUDGET + 500
    fields = spark.createDataFrame([("franquia", "Franquia", "dinheiro", "", []), ("base", "Base", "enum", "", ["x", "y"])], "field_id string, label string, kind string, instruction string, allowed array<string>")

    def provider():
        return lambda system, user: 'Eis: {"campos": [{"campo": "franquia", "valor": "R$ 50.000,00", "trecho": "franquia de R$ 50.000,00", "pagina": 3}, {"campo": "base", "valor": "z", "trecho": "", "pagina": "?"}]} fim'

    cache = spark.createDataFrame([], "key string, answer string")
    got = P.propose(made, groups, fields, "sistema", cache, provider).collect()
    assert [(r.field_id, float(r.value), r.quote, r.page) for r in got] == [("franquia", 50000.0, "franquia de R$ 50.000,00", 3)]
