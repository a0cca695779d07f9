"""Facts proposed by a model: what it is asked about each group of fields, and what its answer becomes.

The model is an injected provider behind a cache of answers. It sees a group's fields and the blocks of the document
that rank best for them, within a budget; what it says is coerced to the field's kind and is only a candidate, which
has to pass verification like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenio.functions import exact as E
from provenio.functions import text as T
from provenio.operators import matching as M
from provenio.operators import retrieval as R
from provenio.sources import store

BEST, BUDGET, FIRST_PAGES, FIRST_BLOCKS = 4, 11_000, 2, 2
ANSWER = "struct<campos:array<struct<campo:string,valor:string,trecho:string,pagina:string>>>"


def contexts(blocks: DataFrame, groups: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (doc_id, group_id, context): the blocks that a group's fields rank best in each document, as one text.

    blocks (doc_id, clause_no, block_no, title, page_start, text); groups (group_id, group_ord, field_id, field_ord, from_start)
    and queries (field_id, q) are declared and small. The first blocks come ahead where from_start says so; blocks that agree
    in clause, page and beginning count once, and one that no longer fits is left out.
    """
    own = blocks.withColumn("block_id", F.concat_ws("/", "clause_no", "block_no"))
    post = R.postings(own.withColumn("key", F.struct("doc_id", "block_id")), R.block_terms(F.col("title"), F.col("text")), "key")
    post = post.select("key.*", "term", "tf", "len")
    lengths = post.groupBy("doc_id", "block_id").agg(F.max("len").alias("len"))
    sizes = lengths.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"))
    terms = queries.select(F.col("field_id").alias("query_id"), F.explode(T.tokens(F.col("q"))).alias("term"))
    asked = sizes.select("doc_id").crossJoin(F.broadcast(terms))  # documents by the declared fields' words
    ranked = R.within_documents(post, sizes, asked, BEST)
    listed = ranked.join(F.broadcast(groups), F.col("query_id") == F.col("field_id"))
    listed = listed.select("doc_id", "group_id", "block_id", (F.col("field_ord") * 1000 + F.col("rank")).cast("long").alias("place"))
    first = own.where(F.col("page_start") <= FIRST_PAGES).groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("clause_no", "block_no", "block_id"))), 1, FIRST_BLOCKS).alias("b"))
    first = first.select("doc_id", F.posexplode("b").alias("i", "b")).select("doc_id", F.col("b.block_id").alias("block_id"), (F.col("i") - 1000).cast("long").alias("place"))
    ahead = first.crossJoin(F.broadcast(groups.where("from_start").select("group_id").distinct()))
    texts = own.select("doc_id", "block_id", "clause_no", "page_start", F.substring("text", 1, 40).alias("begins"), "title", "text", F.length("text").alias("size"))
    both = listed.unionByName(ahead.select(*listed.columns)).join(texts, ["doc_id", "block_id"]).withColumn("key", F.struct("doc_id", "group_id"))
    once = M.first_seen(both, "key", "place", "clause_no", "page_start", "begins")
    chosen = M.select_within_budget(once, "key", "place", "size", BUDGET).select("key", F.posexplode("chosen").alias("i", "place"))
    part = F.concat(F.lit("### "), F.coalesce("title", F.lit("")), F.lit("\n"), "text")
    parts = chosen.join(once.select("key", "place", part.alias("part")), ["key", "place"]).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "part"))).alias("p"))
    return parts.select("key.*", T.neutral_tags(F.array_join(F.transform("p", lambda x: x["part"]), "\n\n")).alias("context"))


def groups_of(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, queries) for contexts and propose, as the field catalogue has them: a group for each grp, searched by its fields' names and clues."""
    first = Window.partitionBy("group_id")
    own = fields.select(F.coalesce("grp", F.lit("")).alias("group_id"), "field_id", "field_ord").withColumn("group_ord", F.min("field_ord").over(first))
    queries = fields.select("field_id", R.field_query(F.col("label"), F.col("clues"), F.col("spec_labels")).alias("q"))
    return own.withColumn("from_start", F.lit(True)), queries


def propose(contexts_: DataFrame, groups: DataFrame, fields: DataFrame, system: str, cache: DataFrame | str, provider: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """Candidates (doc_id, field_id, kind, value, quote, page) from a model's answers; a field that it has no readable value for has none.

    fields (field_id, label, kind, instruction, allowed) are declared; the answer is JSON within whatever else the model says.
    Of several answers for a field the last counts, in order of groups and places. cache: a table of answers, or the path of
    one, where new answers are kept before they are used.
    """
    asked = groups.join(F.broadcast(fields), "field_id")
    line = F.concat(F.lit('- "'), "field_id", F.lit('" ('), "label", F.lit("): "), F.coalesce("instruction", F.lit("")), F.when(F.size("allowed") > 0, F.concat(F.lit(" Chaves permitidas: "), F.array_join("allowed", "; "), F.lit("."))).otherwise(""))
    wanted = asked.groupBy("group_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("field_ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("wanted"))
    prompts = contexts_.join(F.broadcast(wanted), "group_id")
    shape = '{"campos": [{"campo": "<id>", "valor": ..., "trecho": "...", "pagina": N}]}'
    user = F.concat(F.lit("Campos a extrair:\n"), "wanted", F.lit(f"\n\nFormato de resposta: {shape}\n\n<documento>\n"), "context", F.lit("\n</documento>"))
    prompts = prompts.select(F.struct("doc_id", "group_id").alias("prompt_id"), F.lit(system).alias("system"), user.alias("user"))
    answers = store.answered_once(prompts, cache, provider) if isinstance(cache, str) else store.answered(prompts, cache, provider)
    said = answers.select("prompt_id.*", F.from_json(E.json_object(F.col("answer")), ANSWER).alias("a"))
    each = said.select("doc_id", "group_id", F.posexplode("a.campos").alias("place", "c"))
    each = each.select("doc_id", "group_id", "place", F.col("c.campo").alias("field_id"), "c.valor", "c.trecho", "c.pagina")
    known = each.join(F.broadcast(asked.select("group_id", "group_ord", "field_id", "kind", "allowed")), ["group_id", "field_id"])
    value = T.coerce(F.col("kind"), F.col("valor"), F.col("allowed"))
    out = known.withColumn("value", value).where("value is not null")
    found = F.struct("kind", "value", F.coalesce("trecho", F.lit("")).alias("quote"), F.coalesce(F.col("pagina").try_cast("int"), F.lit(0)).alias("page"))
    last = out.groupBy("doc_id", "field_id").agg(F.max_by(found, F.struct("group_ord", "place")).alias("x"))
    return last.select("doc_id", "field_id", "x.*")
