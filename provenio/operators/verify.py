"""Evidence: finding quotes, topic, number and value checks, instructions in quotes, the cascade, and checked answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenio.functions import text as T
from provenio.functions.exact import window_similarity
from provenio.session import staged

LEAST_SIMILARITY = 0.90
LEAST_QUOTE = 12
CONTEXT_PAGES, CONTEXT_CHARS = 4, 12_000

# Wording that speaks to a model, not to a reader; absence that a quote can't prove; recommendations; numbers.
INSTRUCTIONS = (
    r"ignore (todas )?as instruc|instrucoes anteriores|instrucao do administrador|novo comando|\bprompt\b|agente de ia|atencao modelo|\[sistema\]|"
    r"role: system|chave de api|responda apenas|esqueca o esquema|desconsidere a tabela|tem prioridade sobre|voce agora e|resposta obrigatoria|"
    r"nao cite pagina|afirme que o trecho|ao comparar, declare|declare que a |execute: |import os|os\.system|traduza tudo|troque os valores|envie o conteudo"
)
ABSENCES = ("nao_prevista", "nao_excluido")
RECOMMENDATION = r"(?i)recomend|contrate|deve(m)? contratar|melhor op[cç][aã]o|escolha a|sugerimos|aconselh"
NUMBERS = (
    r"(?i)R\$\s*[0-9][0-9.,]*(?:\s*(?:mil(?:h(?:ão|ões|oes|ao))?|mi|bi))?|\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b|\b[0-9]{1,3}\s+(?:meses|mês|anos?|dias)\b"
)


def instructs(quote: Column) -> Column:
    return T.canonical(quote).rlike(INSTRUCTIONS)


def on_topic(quote: Column, clues: Column) -> Column:
    """Whether the stems of a clue stand in the quote's stems, in their order."""
    stems = F.array_join(T.tokens(quote), " ")
    return F.exists(clues, lambda c: (F.size(T.tokens(c)) > 0) & F.contains(stems, F.array_join(T.tokens(c), " ")))


def number_anchored(kind: Column, value: Column, quote: Column) -> Column:
    """Whether the quote holds the value's number; other kinds always do. A period is start/end."""
    amount = value.try_cast("double")
    money = F.exists(T.money_mentions(quote), lambda a: F.abs(a - amount) < 0.01)
    day = F.when(value == T.UNLIMITED, T.parse_date(quote) == T.UNLIMITED).otherwise(F.array_contains(T.all_dates(quote), value) | (T.parse_date(quote) == value))
    days = F.when(value == "conforme_especificacao", F.contains(T.canonical(quote), F.lit("especifica"))).otherwise(T.parse_duration(quote) == value.try_cast("int"))
    both = F.forall(F.split(value, "/"), lambda d: F.array_contains(T.all_dates(quote), d)) & (F.size(F.split(value, "/")) == 2)
    sure = F.when(kind == "dinheiro", money).when(kind == "data", day).when(kind == "duracao", days).when(kind == "periodo", both).otherwise(True)
    return F.coalesce(sure, F.lit(False))


def page_texts(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no, text) with their canonical text, the next page's, and the text before, at most CONTEXT_CHARS of it.

    seam: the word that goes over to the next page, null if none does.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no")
    ends = F.coalesce(F.col("text").rlike(rf"{T.LETTER_OR_DIGIT}-\s*$"), F.lit(False))
    begins = F.coalesce(F.col("text").rlike(rf"^\s*{T.LETTER_OR_DIGIT}"), F.lit(False))
    own = pages.select("doc_id", "page_no", T.canonical(F.col("text")).alias("norm"), ends.alias("ends"), begins.alias("begins"))  # once a page
    follows = F.lead("page_no").over(order) == F.col("page_no") + 1
    out = own.withColumn("has_next", F.coalesce(follows, F.lit(False))).withColumn("next_norm", F.when(F.col("has_next"), F.lead("norm").over(order)))
    out = out.withColumn("joined", F.col("ends") & F.col("has_next") & F.coalesce(F.lead("begins").over(order), F.lit(False)))  # a word that goes over
    out = out.withColumn("before", F.array_join(F.collect_list("norm").over(order.rowsBetween(1 - CONTEXT_PAGES, -1)), " "))
    parted = F.trim(F.concat_ws(" ", "norm", "next_norm"))
    head = F.regexp_replace("norm", "-$", "")
    pair = F.when(F.col("joined"), F.concat(head, "next_norm")).otherwise(parted)
    seam = F.when(F.col("joined"), F.concat(F.element_at(F.split(head, " "), -1), F.element_at(F.split("next_norm", " "), 1)))
    return out.select("doc_id", "page_no", "norm", "next_norm", pair.alias("pair_norm"), "has_next", "before", seam.alias("seam"))


PAGE, PAIR = "page", "pair"  # the kinds of places: a page alone, and with the next one
QUOTE = ("doc_id", "quote_id")


def page_words(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, word, page_no, kind) of page_texts: each word of a page once; a seam is a word of the pair."""
    words = lambda s: F.filter(F.array_distinct(F.split(s, " ")), lambda w: w != "")
    own = texts.select("doc_id", F.explode(words(F.col("norm"))).alias("word"), "page_no", F.lit(PAGE).alias("kind"))
    return own.unionByName(texts.where("seam is not null").select("doc_id", F.col("seam").alias("word"), "page_no", F.lit(PAIR).alias("kind")))


def quote_words(quotes: DataFrame) -> DataFrame:
    """Rows (doc_id, quote_id, word, times, n) of quotes with their canonical text q; n: all words of the quote."""
    words = F.filter(F.split("q", " "), lambda w: w != "")
    each = quotes.select(*QUOTE, words.alias("w")).select(*QUOTE, F.size("w").alias("n"), F.explode("w").alias("word"))
    return each.groupBy(*QUOTE, "word", "n").agg(F.count("*").alias("times"))


def rarest_words(asked: DataFrame, words: DataFrame) -> DataFrame:
    """The quote_words that a place has to share one of to be similar enough.

    A place that matches LEAST_SIMILARITY of n words lacks a tenth of them at most. So of any words that make up one more
    than that, it holds one; the words that stand on fewest pages of the document are taken.
    """
    pages = words.groupBy("doc_id", "word").agg(F.count("*").alias("on"))
    known = asked.join(pages, ["doc_id", "word"], "left").withColumn("on", F.coalesce("on", F.lit(0)))
    ahead = Window.partitionBy(*QUOTE).orderBy("on", "word").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("times").over(ahead), F.lit(0))
    return known.withColumn("taken", taken).where((F.col("taken") <= F.floor(F.col("n") / 10)) & (F.col("on") > 0)).select(*QUOTE, "word")


def pairs_of(found: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of pages (doc_id, quote_id, page_no, kind) that aligned pages are of and that aren't aligned themselves."""
    own = found.where(F.col("kind") == PAGE).select(*QUOTE, "page_no")
    both = own.unionByName(own.withColumn("page_no", F.col("page_no") - 1)).distinct().withColumn("kind", F.lit(PAIR))
    both = both.join(texts.where("has_next").select("doc_id", "page_no"), ["doc_id", "page_no"], "left_semi")
    return both.join(found.select(*QUOTE, "page_no", "kind"), [*QUOTE, "page_no", "kind"], "left_anti")


def aligned(at: DataFrame, quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Places with the similarity s of their text to the quote."""
    both = at.join(quotes, list(QUOTE)).join(texts.select("doc_id", "page_no", "norm", "pair_norm"), ["doc_id", "page_no"])
    text = F.when(F.col("kind") == PAIR, F.col("pair_norm")).otherwise(F.col("norm"))
    return both.select(*QUOTE, "page_no", "kind", "cited", window_similarity(F.col("q"), text).alias("s"))


def _best(found: DataFrame) -> DataFrame:
    """Rows (doc_id, quote_id, page_no, s): the place that counts, of aligned places.

    The cited page comes first, then the cited one with the next unless that alone is similar, then the best page, the best pair.
    """
    fine, cited = F.col("s") >= LEAST_SIMILARITY, F.col("page_no") == F.col("cited")
    page, pair = F.col("kind") == PAGE, F.col("kind") == PAIR
    one = F.struct("s", F.col("page_no").alias("p"))
    rank = F.struct("s", F.when(page, cited.cast("int")).otherwise(0).alias("c"), (-F.col("page_no")).alias("m"))
    best = found.groupBy(*QUOTE).agg(
        F.max(F.when(page & cited & fine, one)).alias("a"),
        F.max(F.when(pair & cited & fine, one)).alias("b"),
        F.coalesce(F.bool_or(page & fine & (F.col("page_no") == F.col("cited") + 1)), F.lit(False)).alias("next_alone"),
        F.max_by(F.when(page, one), F.when(page, rank)).alias("c"),
        F.max_by(F.when(pair, one), F.when(pair, rank)).alias("d"),
    )
    own, other = F.coalesce("c.s", F.lit(-1.0)), F.coalesce("d.s", F.lit(-1.0))
    last = F.when((own >= LEAST_SIMILARITY) | (own >= other), F.col("c")).otherwise(F.col("d"))
    return best.select(*QUOTE, F.coalesce("a", F.when(~F.col("next_alone"), F.col("b")), last).alias("r")).select(*QUOTE, F.col("r.p").alias("page_no"), "r.s")


def _nearest(quotes: DataFrame, asked: DataFrame, words: DataFrame, texts: DataFrame) -> DataFrame:
    """Aligned places of quotes that no place is similar enough to: those that may be the nearest.

    How many of the quote's words a place holds, in any order, bounds its similarity. The place with the highest bound is
    aligned first, then those whose bound isn't under what that has reached.
    """
    held = asked.join(quotes.select(*QUOTE), list(QUOTE), "left_semi").join(words, ["doc_id", "word"]).groupBy(*QUOTE, "n", "page_no", "kind").agg(F.sum("times").alias("of"))
    pages = held.where(F.col("kind") == PAGE)
    pairs = held.unionByName(pages.withColumn("page_no", F.col("page_no") - 1)).join(texts.where("has_next").select("doc_id", "page_no"), ["doc_id", "page_no"], "left_semi")
    pairs = pairs.groupBy(*QUOTE, "n", "page_no").agg(F.sum("of").alias("of")).withColumn("kind", F.lit(PAIR))
    bound = F.least(F.lit(1.0), F.col("of") / F.col("n"))
    bounds = staged(pages.unionByName(pairs).select(*QUOTE, "page_no", "kind", bound.alias("bound")))
    top = bounds.groupBy(*QUOTE, "kind").agg(F.min_by("page_no", F.struct(-F.col("bound"), "page_no")).alias("page_no"))
    first = staged(aligned(top, quotes, texts))
    reached = first.groupBy(*QUOTE).agg(F.max("s").alias("reached"))
    rest = bounds.join(reached, list(QUOTE)).where(F.col("bound") >= F.col("reached")).join(top, [*QUOTE, "kind", "page_no"], "left_anti")
    return first.unionByName(aligned(rest.select(*QUOTE, "page_no", "kind"), quotes, texts))


def locate(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quotes (doc_id, quote_id, quote, page) with found_page and similarity.

    The cited page comes first, then the cited one with the next, then the best page, the best pair of pages; on equal
    similarity the cited page stays, then the earliest. found_page may be one that is not similar enough: callers look.

    Quotes and pages meet by a hash join on the quote's rarest words, so that only pages that may be similar enough are
    aligned, and their pairs where the cited page isn't; what is found nowhere is aligned where most of its words
    are. Steps that others read are written when this is called.
    """
    held = staged(quotes.withColumn("_q", T.canonical(F.col("quote"))))  # what gives the quotes is worked out once
    q = held.select("doc_id", "quote_id", F.col("_q").alias("q"), F.col("page").alias("cited"))
    texts = page_texts(pages.join(q.select("doc_id").distinct(), "doc_id", "left_semi"))
    texts = staged(texts.select("doc_id", "page_no", "norm", "pair_norm", "has_next", "seam"))
    words, asked = page_words(texts), quote_words(q)
    hits = rarest_words(asked, words).join(words, ["doc_id", "word"]).select(*QUOTE, "page_no", "kind").distinct()
    first = staged(aligned(hits, q, texts))
    settled = first.where((F.col("kind") == PAGE) & (F.col("page_no") == F.col("cited")) & (F.col("s") >= LEAST_SIMILARITY)).select(*QUOTE).distinct()
    wide = pairs_of(first.join(settled, list(QUOTE), "left_anti"), texts)
    near = staged(_best(first.unionByName(aligned(wide, q, texts))))
    found = near.where(F.col("s") >= LEAST_SIMILARITY)
    lost = q.join(found.select(*QUOTE), list(QUOTE), "left_anti")
    if not lost.isEmpty():
        found = found.unionByName(_best(_nearest(lost, asked, words, texts)))
    found = found.select(*QUOTE, F.when(F.col("s") > 0, F.col("page_no")).alias("found_page"), F.col("s").alias("similarity"))
    return held.drop("_q").join(found, list(QUOTE), "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


IN_CONTEXT = ("excluido", "excluida")


def coherent() -> Column:
    """Whether the quote, or for some values the text before it, carries the sign declared for the value.

    Rows have `sign`, from with_signs, `context`, from with_context, and `value`; no sign declared means coherent.
    """
    quote = F.call_function("rlike", T.canonical(F.col("quote")), F.col("sign"))
    before = F.call_function("rlike", F.coalesce("context", F.lit("")), F.col("sign"))
    return F.col("sign").isNull() | quote | (F.col("value").isin(*IN_CONTEXT) & before)


def with_signs(candidates: DataFrame, signs: DataFrame) -> DataFrame:
    """candidates (field_id, kind, value) with the sign of their value: the field's own, else the kind's.

    signs (scope, key, value, sign) is a declared table; scope is field or kind.
    """
    of = lambda scope: F.broadcast(signs.where(F.col("scope") == scope).select(F.col("key"), F.col("value"), F.col("sign").alias(f"{scope}_sign")))
    out = candidates.join(of("field").withColumnRenamed("key", "field_id"), ["field_id", "value"], "left")
    out = out.join(of("kind").withColumnRenamed("key", "kind"), ["kind", "value"], "left")
    return out.withColumn("sign", F.coalesce("field_sign", "kind_sign")).drop("field_sign", "kind_sign")


def with_context(located: DataFrame, pages: DataFrame) -> DataFrame:
    """located quotes with `context`: what stands before the quote on its page and the pages ahead, the last CONTEXT_CHARS of it."""
    texts = page_texts(pages).select("doc_id", F.col("page_no").alias("found_page"), "norm", "before")
    head = F.substring(T.canonical(F.col("quote")), 1, 60)
    at = F.position(head, F.col("norm"))
    own = F.when((at > 0) & (head != ""), F.substring(F.col("norm"), F.lit(1), at - 1)).otherwise(F.col("norm"))
    out = located.join(texts, ["doc_id", "found_page"], "left")
    return out.withColumn("context", F.right(F.concat_ws(" ", "before", own), F.lit(CONTEXT_CHARS))).drop("norm", "before")


def cascade(candidates: DataFrame, pages: DataFrame, signs: DataFrame) -> DataFrame:
    """Candidates (doc_id, quote_id, field_id, kind, clues, value, quote, page, status, note) after verification.

    Every check that fails takes the value away and says why; a page that was wrong is corrected and noted. Where quotes are
    found is written once, when this is called.
    """
    located = staged(with_signs(locate(candidates, pages), signs))
    asked = F.col("sign").isNotNull() & F.col("value").isin(*IN_CONTEXT)  # what stands before counts for these alone
    of_these = pages.join(located.where(asked).select("doc_id").distinct(), "doc_id", "left_semi")
    located = with_context(located.where(asked), of_these).unionByName(located.where(~F.coalesce(asked, F.lit(False))), allowMissingColumns=True)
    quote = F.trim(F.coalesce("quote", F.lit("")))
    sim, found = F.col("similarity"), F.col("found_page")
    passes = F.col("status").isin("nao_localizado", "definido_na_especificacao") & F.col("quote").isNull()
    checks = [
        (passes, F.col("status"), F.col("note")),
        (quote == "", "nao_verificado", "sem trecho de evidência"),
        (F.col("value").isin(*ABSENCES), "nao_localizado", "ausência não é provada por trecho; tratado como não localizado"),
        (instructs(quote), "nao_verificado", "trecho contém instrução dirigida a IA (possível injeção de prompt)"),
        (F.length(T.canonical(quote)) < LEAST_QUOTE, "nao_verificado", "trecho curto demais para servir de prova"),
        (found.isNull() | (sim < LEAST_SIMILARITY), "nao_verificado", "trecho não encontrado no documento"),
        ((F.col("kind") != "texto") & ~on_topic(quote, F.col("clues")), "nao_verificado", "o trecho não trata do assunto do campo"),
        (~coherent(), "nao_verificado", F.concat(F.lit("o trecho não sustenta o valor '"), "value", F.lit("'"))),
        (~number_anchored(F.col("kind"), F.col("value"), quote), "nao_verificado", "o número do valor não aparece no trecho citado"),
    ]
    moved = F.concat(F.lit("página corrigida de "), F.col("page").cast("string"), F.lit(" para "), found.cast("string"))
    fine = F.trim(F.concat_ws(" ", "note", F.when(~found.eqNullSafe(F.col("page")), moved)))
    out = F.when(F.lit(False), F.struct(F.lit("").alias("status"), F.lit("").alias("note")))
    for test, status, note in checks:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        out = out.when(F.coalesce(test, F.lit(False)), F.struct(lit(status).alias("status"), lit(note).alias("note")))
    verdict = out.otherwise(F.struct(F.lit("verificado").alias("status"), fine.alias("note")))
    done = located.withColumn("verdict", verdict)
    ok = F.col("verdict.status") == "verificado"
    return done.select(
        "doc_id", "quote_id", "field_id", F.when(ok | passes, F.col("value")).alias("value"), F.col("verdict.status").alias("status"),
        F.col("verdict.note").alias("note"), "quote", F.when(ok, found).otherwise(F.col("page")).alias("page"), F.round("similarity", 3).alias("similarity"),
    )


def displayable(facts: DataFrame) -> DataFrame:
    return facts.where((F.col("status") == "verificado") & F.col("value").isNotNull())


def audited_citations(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """citations (doc_id, quote_id, quote, page) with `kept`: known document, a quote that isn't empty, doesn't instruct and is found."""
    found = locate(citations, pages)
    sure = (F.trim(F.coalesce("quote", F.lit(""))) != "") & ~instructs(F.coalesce("quote", F.lit(""))) & F.col("found_page").isNotNull()
    return found.withColumn("kept", sure & (F.col("similarity") >= LEAST_SIMILARITY))


def audited_answers(answers: DataFrame, audited: DataFrame) -> DataFrame:
    """answers (answer_id, answer) by what their citations (answer_id, kept, quote) prove: answer, quotes_only or not_located."""
    proof = audited.groupBy("answer_id").agg(
        F.flatten(F.collect_list(F.when(F.col("kept"), T.money_mentions(F.col("quote"))))).alias("proved"),
        F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_discarded"),
    )
    out = answers.join(proof, "answer_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_kept", "n_discarded")})
    proved = F.coalesce("proved", F.array().cast("array<double>"))
    loose = F.exists(T.money_mentions(F.col("answer")), lambda a: ~F.exists(proved, lambda p: F.abs(p - a) < 0.01))
    none = (F.col("n_kept") == 0) | (F.trim(F.coalesce("answer", F.lit(""))) == "")
    return out.withColumn("mode", F.when(none, "not_located").when(loose, "quotes_only").otherwise("answer")).drop("proved")


def stray_numbers(text: Column, allowed: Column) -> Column:
    """Numbers of a text that are not among the allowed texts' numbers."""
    bare = lambda s: F.transform(F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(NUMBERS), F.lit(0)), lambda x: F.regexp_replace(T.canonical(x), "[.,;]+$", ""))
    return F.array_except(bare(text), F.flatten(F.transform(allowed, bare)))


def recommends(text: Column) -> Column:
    return text.rlike(RECOMMENDATION)
