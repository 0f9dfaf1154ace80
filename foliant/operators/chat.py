"""Prompt context, history, citations and stream frames of a chat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import basename, col, filled, strip

MODES = ("model", "agent", "rag")
#: System prompts by case; {context} is replaced. They are parameters, any wording may be passed.
TEMPLATES = {
    "rag": "Answer only from these fragments and cite them as [N].\n\n{context}",
    "model": "Use these fragments as a basis and mark your own conclusions.\n\n{context}",
    "model_no_sources": "No relevant document was found; say that the answer is general knowledge.",
    "agent": "Work strictly in this agent's role.\n\n{context}",
}
NO_SOURCES = "No relevant information was found in the documents. Refine the question or add documents."


def normalized_mode(c: Column | str) -> Column:
    """A supported mode; anything else, null included, is ``rag``."""
    mode = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    return F.when(mode.isin(*MODES), mode).otherwise("rag")


def history(messages: DataFrame, n: int = 5, group: str = "notebook_id", order: str = "seq") -> DataFrame:
    """The last n messages of each conversation, in order, then without blank ones."""
    last = Window.partitionBy(group).orderBy(F.desc(order))
    rows = messages.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= n).drop("_r")
    return rows.filter(strip(F.coalesce("content", F.lit(""))) != "")


def source_order(sources: DataFrame, group: str = "notebook_id", by: tuple[str, ...] = ("sort_order", "added_at"), tie: str = "id") -> DataFrame:
    """``doc_order``: position of each source in its notebook, from 1."""
    return sources.withColumn("doc_order", F.row_number().over(Window.partitionBy(group).orderBy(*by, tie)).cast("bigint"))


def context(hits: DataFrame, by: str = "qid", order: str = "rank") -> DataFrame:
    """(qid, context): ``[N] file (стр. page):`` and text of each hit, joined by blank lines.

    N is the source's ``doc_order``, else the hit's place; hits without text are
    skipped but counted. A query's hits are bounded by its top n.
    """
    name = F.coalesce(filled(basename("source")), F.lit("unknown"))
    page = F.when(F.col("page").isNotNull(), F.format_string(" (стр. %d)", "page")).otherwise("")
    body = strip(F.coalesce("text", F.lit("")))
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    ref = F.coalesce(F.col("doc_order"), place).cast("string")
    rows = hits.select(by, F.col(order).alias("_o"), F.when(body != "", F.concat(F.lit("["), ref, F.lit("] "), name, page, F.lit(":\n"), body)).alias("_p"))
    ordered = F.sort_array(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_o", "_p"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["_p"]), "\n\n").alias("context"))


def prompt(mode: Column | str, context_: Column | str, templates: dict[str, str] | None = None) -> Column:
    """System prompt of a mode; the model mode has its own for an empty context."""
    t = TEMPLATES | (templates or {})
    m, c = normalized_mode(mode), F.coalesce(col(context_), F.lit(""))
    fill = lambda name: F.replace(F.lit(t[name]), F.lit("{context}"), c)
    agent = F.replace(F.lit(t["agent"]), F.lit("{context}"), F.coalesce(filled(c), F.lit("id=agent\nrole=generalist")))
    return F.when(m == "rag", fill("rag")).when(m == "agent", agent).when(c != "", fill("model")).otherwise(F.lit(t["model_no_sources"]))


def reply_without_sources(mode: Column | str, found: Column | str) -> Column:
    """The fixed reply of the rag mode where nothing was found, else null: the model is called."""
    return F.when((normalized_mode(mode) == "rag") & ~F.coalesce(col(found), F.lit(False)), F.lit(NO_SOURCES))


def deduped_citations(citations: DataFrame, by: str = "message_id", pos: str = "pos") -> DataFrame:
    """The best-scored citation of each doc_order, first one of ties, in order of doc_order."""
    order = Window.partitionBy(by, "doc_order").orderBy(F.desc("score"), pos)
    return citations.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def agent_label(name: Column | str, ident: Column | str, default: str = "agent") -> Column:
    n, i = filled(strip(F.coalesce(col(name), F.lit("")))), filled(strip(F.coalesce(col(ident), F.lit(""))))
    return F.when(n.isNotNull() & i.isNotNull(), F.concat(n, F.lit(" ["), i, F.lit("]"))).otherwise(F.coalesce(n, i, F.lit(default)))


def frame(event: Column | str, payload: Column) -> Column:
    """One server-sent event; null fields of the payload are left out."""
    return F.concat(F.lit("event: "), col(event), F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def stream_tokens(lines: DataFrame, raw: str = "line", order: str = "pos", by: str = "stream_id") -> DataFrame:
    """(by, order, token): tokens of provider stream lines up to ``[DONE]``; blank, broken and empty lines give none."""
    data = strip(F.regexp_replace(F.col(raw), r"^\s*data:", ""))
    done = F.max(F.when(data == "[DONE]", 1).otherwise(0)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    token = F.coalesce(F.get_json_object(data, "$.message.content"), F.get_json_object(data, "$.choices[0].delta.content"))
    rows = lines.select(by, order, token.alias("token"), done.alias("_done"))
    return rows.filter((F.col("_done") == 0) & (F.coalesce(F.col("token"), F.lit("")) != "")).drop("_done")


def embedding_of(response: Column | str, size: int) -> Column:
    """Vector of an embedding response in any of the three shapes, cut or padded with zeros to ``size``; null if there is none."""
    shape = "struct<embeddings: array<array<double>>, data: array<struct<embedding: array<double>>>, embedding: array<double>>"
    parsed = F.from_json(col(response), shape)
    vector = F.coalesce(F.get(parsed["embeddings"], F.lit(0)), F.get(parsed["data"], F.lit(0))["embedding"], parsed["embedding"])
    vector = F.when(F.size(vector) > 0, vector)
    return F.concat(F.slice(vector, 1, size), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), size - F.size(vector))))


def contains_any(c: Column | str, words: list[str]) -> Column:
    low = F.lower(strip(col(c)))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


# Parts of model names.
NOT_CHAT = ["embed", "embedding", "rerank", "reranker", "bge-m3", "bge-large", "e5", "gte"]
EMBEDDING = ["embed", "embedding", "bge", "e5", "gte", "nomic-embed", "mxbai-embed"]


def is_chat_model(c: Column | str) -> Column:
    return F.coalesce((strip(col(c)) != "") & ~contains_any(c, NOT_CHAT), F.lit(False))


def is_embedding_model(c: Column | str) -> Column:
    return F.coalesce((strip(col(c)) != "") & ~contains_any(c, ["rerank"]) & contains_any(c, EMBEDDING), F.lit(False))


def model_candidates(c: Column | str) -> Column:
    """A model's name and, where it differs, the part before its tag."""
    return F.array_distinct(F.array(col(c), F.split_part(col(c), F.lit(":"), F.lit(1))))


def normalized_agents(manifests: DataFrame) -> DataFrame:
    """Agent manifests with an id and a name, stripped, with defaults for version, tools, provider and model."""

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(filled(strip(F.col(name).cast("string"))), F.lit(default))

    tools = F.filter(F.transform("requires", lambda x: strip(x)), lambda x: x.isNotNull() & (x != "")) if "requires" in manifests.columns else F.array().cast("array<string>")
    rows = manifests.select(
        text("id").alias("id"),
        text("name").alias("name"),
        text("description").alias("description"),
        text("version", "0.0.0").alias("version"),
        F.lower(text("provider", "ollama")).alias("provider"),
        text("model").alias("model"),
        F.when(F.size(tools) > 0, tools).otherwise(F.array(F.lit("agent"))).alias("requires"),
    )
    return rows.filter("id <> '' AND name <> ''")


def by_precedence(payload: Column | str, manifest: Column | str, default: str) -> Column:
    """A request's value, else its agent's, else the default; only empty values fall through."""
    return F.coalesce(filled(col(payload)), filled(col(manifest)), F.lit(default))


def resolved_agents(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """Each request (agent_id) with the agent of that id, else the first by name and id; ``manifests`` is a short list."""
    named = manifests.select(*[F.col(c).alias(f"agent_{c}") for c in manifests.columns])
    first = manifests.orderBy("name", "id").limit(1).select(F.struct(*manifests.columns).alias("_first"))
    joined = requests.withColumnRenamed("agent_id", "_asked").join(named, F.col("_asked") == F.col("agent_id"), "left").crossJoin(F.broadcast(first))
    return joined.select(*[F.col("_asked").alias("asked_id") if c == "agent_id" else F.col(c) for c in requests.columns], *[F.coalesce(f"agent_{c}", f"_first.{c}").alias(f"agent_{c}") for c in manifests.columns])


def cited(answers: DataFrame, citations: DataFrame, message: str = "message_id", text: str = "content", pos: str = "pos") -> DataFrame:
    """(message, place, ref, citation columns): each ``[N]`` of an answer with the first of its citations of that order, or none."""
    from foliant.functions.text import citation_refs

    order = Window.partitionBy(message, "doc_order").orderBy(pos)
    first = citations.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", pos)
    refs = answers.select(message, F.posexplode(citation_refs(text)).alias("place", "ref"))
    return refs.join(first.withColumnRenamed("doc_order", "ref"), [message, "ref"], "left")


def stream_counters(tokens: DataFrame, by: str = "stream_id") -> DataFrame:
    """(by, packets, chars) of what was sent of each stream."""
    return tokens.groupBy(by).agg(F.count(F.lit(1)).alias("packets"), F.sum(F.char_length("token")).cast("bigint").alias("chars"))


def answer_frames(tokens: DataFrame, ends: DataFrame, by: str = "stream_id", order: str = "pos") -> DataFrame:
    """(by, seq, frame): the events of each stream in the order of the contract.

    tokens: by, order, token; ends: by, citations (JSON array, null for none), message_id, error (null if all went well), fenced
    (cleared meanwhile). Tokens come first, then citations and done; after an error, error and done. A stream that
    failed or was fenced ends with an empty message id.
    """
    part = lambda df, stage, at, event, data: df.select(by, F.lit(stage).alias("_s"), at.alias("_o"), frame_of(event, data).alias("frame"))
    one, failed = F.lit(0).cast("bigint"), F.col("error").isNotNull()
    last = F.when(failed | F.coalesce("fenced", F.lit(False)), F.lit("")).otherwise(F.coalesce("message_id", F.lit("")))
    parts = [
        part(tokens, 0, F.col(order).cast("bigint"), "token", F.to_json(F.struct(F.col("token").alias("text")))),
        part(ends.filter(~failed), 1, one, "citations", F.coalesce("citations", F.lit("[]"))),
        part(ends.filter(failed), 1, one, "error", F.to_json(F.struct(F.col("error").alias("detail")))),
        part(ends, 2, one, "done", F.to_json(F.struct(last.alias("message_id")))),
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy("_s", "_o")).cast("bigint")).select(by, "seq", "frame")


def frame_of(event: str, data: Column) -> Column:
    """One server-sent event of text that is JSON already."""
    return F.concat(F.lit(f"event: {event}\ndata: "), data, F.lit("\n\n"))


def message_lists(requests: DataFrame, turns: DataFrame, by: str = "qid", order: str = "seq", templates: dict[str, str] | None = None) -> DataFrame:
    """(by, messages): the system prompt of each request's mode, then its history (role, content) in order.

    requests: by, mode, context, found (whether sources were found); a model request without sources gets no context.
    """
    mode = normalized_mode("mode")
    kept = F.when((mode == "model") & ~F.coalesce("found", F.lit(False)), F.lit("")).otherwise(F.coalesce("context", F.lit("")))
    said = turns.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, "role", "content"))).alias("_t"))  # bounded by the history's length
    system = F.struct(F.lit("system").alias("role"), prompt("mode", kept, templates).alias("content"))
    rest = F.transform(F.coalesce("_t", F.array().cast(f"array<struct<{order}:{dict(turns.dtypes)[order]},role:string,content:string>>")), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return requests.join(said, by, "left").select(by, F.concat(F.array(system), rest).alias("messages"))


def agent_card(ident: Column | str, name: Column | str, description: Column | str, tools: Column | str, requires: Column | str) -> Column:
    """What an agent is told about itself, one line each; lists without entries read ``n/a``."""
    listed_ = lambda c: F.coalesce(filled(F.array_join(col(c), ", ")), F.lit("n/a"))
    line = lambda key, v: F.concat(F.lit(f"{key}="), v)
    plain = lambda c, default="": F.coalesce(col(c), F.lit(default))
    return F.concat_ws("\n", line("id", plain(ident)), line("name", plain(name, "Assistant")), line("description", plain(description)), line("tools", listed_(tools)), line("requires", listed_(requires)))
