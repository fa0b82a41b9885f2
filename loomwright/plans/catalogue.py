"""Every query of the analytics operators, and the DuckDB SQL that most of them are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import rounded
from ..operators import attempts, calls, chat, decay, errors, responses, retrieval, runs
from ..operators.index import VectorIndex
from ..sources import io
from ..sources.shared import shared_folder
from ..streaming import progress
from . import arriving, derived, oracles, stored

Query = Callable[[SparkSession, str], DataFrame]

SUBSET = 100
SYSTEM = "You are a careful programmer."


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.view(spark, sf_dir, derived.ATTEMPT_LOG, "orders")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.hazards(attempts.passes(_log(spark, sf_dir)))


def _fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each model with everything that the result is made of."""
    counted = _counted(spark, sf_dir).withColumn("norm", attempts.effectiveness(F.col("steps"))).withColumn("points", attempts.points(F.col("norm")))
    solved = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x)
    return decay.with_fit(counted.withColumn("A_phi", rounded(solved.cast("double") / F.col("total") * 100.0)))


def ddi_pass_counts(spark, sf_dir):
    return attempts.influence(_log(spark, sf_dir)).select("model", "i", "S_i")


def ddi_influence(spark, sf_dir):
    return attempts.influence(_log(spark, sf_dir)).select("model", "i", "S_i", "N_i", rounded(F.col("I_i"), 9).alias("I_i"), "pct")


def ddi_norm_effectiveness(spark, sf_dir):
    norm = _counted(spark, sf_dir).select("model", attempts.effectiveness(F.col("steps")).alias("norm"))
    return norm.select("model", F.explode("norm").alias("key", "value"))


def ddi_overall(spark, sf_dir):
    return attempts.overall(attempts.passes(_log(spark, sf_dir)))


def ddi_summary_lines(spark, sf_dir):
    return _counted(spark, sf_dir).select("model", F.posexplode(attempts.summary_lines(F.col("steps"))).alias("i", "line"))


def ddi_fit(spark, sf_dir):
    return _fitted(spark, sf_dir).select("model", *decay.rounded_record())


def ddi_thresholds(spark, sf_dir):
    rows = _fitted(spark, sf_dir).select("model", F.explode(decay.thresholds(F.col("lambda"))).alias("x"))
    return rows.select("model", "x.theta", rounded(F.col("x.t_theta"), 3).alias("t_theta"), F.col("x.t_theta_ceiling").alias("t_theta_ceiling"))


def ddi_decay_curve(spark, sf_dir):
    fit = _fitted(spark, sf_dir).withColumn("t", decay.thresholds(F.col("lambda")))
    until = F.array_max(F.transform("t", lambda x: x["t_theta_ceiling"])).cast("double")
    rows = fit.select("model", F.explode(decay.curve(F.col("fitted_E_0"), F.col("lambda"), until)).alias("x"))
    return rows.select("model", "x.k", rounded(F.col("x.t"), 3).alias("t"), rounded(F.col("x.e"), 3).alias("e"))


def ddi_result(spark, sf_dir):
    fit = _fitted(spark, sf_dir).withColumn("t", decay.thresholds(F.col("lambda")))
    first = F.try_element_at(F.col("norm"), F.lit("E_0")).alias("E_0")
    lists = [F.transform("t", lambda x: x["theta"]).alias("theta"), F.transform("t", lambda x: rounded(x["t_theta"], 3)).alias("t_theta"), F.transform("t", lambda x: x["t_theta_ceiling"]).alias("t_theta_ceiling")]
    return fit.select("model", first, *decay.rounded_record(), *lists, "A_phi")


def run_status(spark, sf_dir):
    return runs.progress(runs.outcomes(derived.view(spark, sf_dir, derived.RUNS, "lineitem")))


def fresh_start_sessions(spark, sf_dir):
    return chat.sessions(derived.view(spark, sf_dir, derived.RUNS, "lineitem"), 2)


def dataset_subset(spark, sf_dir):
    """The first rows by id: the subset is the feature."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").limit(SUBSET)


def result_schema_dispatch(spark, sf_dir):
    log = _log(spark, sf_dir).withColumns({"problem_id": F.col("task").cast("string"), "library": F.col("model"), "task_id": F.col("task").cast("string")})
    by_library = F.col("task") % 2 == 0
    return runs.appended(runs.result_rows(log.where(by_library), True), runs.result_rows(log.where(~by_library), False))


def _stderr(spark, sf_dir):
    return derived.view(spark, sf_dir, derived.STDERR_LOG, "events")


def err_tracebacks(spark, sf_dir):
    blocks = errors.tracebacks(F.col("stderr"))
    return _stderr(spark, sf_dir).select("event_id", F.size(blocks).alias("n"), F.array_join(blocks, "\n~\n").alias("blocks"))


def err_type(spark, sf_dir):
    return _stderr(spark, sf_dir).select("event_id", errors.error_type(F.col("stderr")).alias("error_type"))


def err_target_only(spark, sf_dir):
    return _stderr(spark, sf_dir).select("event_id", errors.from_target(errors.without_generic(F.col("stderr"))).alias("message"))


def err_test_case(spark, sf_dir):
    return _stderr(spark, sf_dir).select("event_id", errors.test_case(F.col("stderr"), "candidate", F.lit("solve")).alias("test_case"))


def err_name_line(spark, sf_dir):
    return _stderr(spark, sf_dir).select("event_id", errors.name_error_line(F.col("stderr")).alias("line"))


def err_is_unittest(spark, sf_dir):
    return _stderr(spark, sf_dir).select("event_id", errors.is_unittest(F.col("stderr")).alias("is_unittest"))


def err_unittest_summary(spark, sf_dir):
    first = F.get(F.split("stderr", "\n"), F.lit(0))
    tests = _stderr(spark, sf_dir).where(errors.is_unittest(F.col("stderr")))
    return tests.select("event_id", errors.outcome_summary(first).alias("summary"), errors.failures(first).alias("failures"))


def err_prompt(spark, sf_dir):
    return errors.with_prompt(_stderr(spark, sf_dir), "stderr").select("event_id", "prompt")


def _responses(spark, sf_dir):
    return derived.view(spark, sf_dir, derived.RESPONSES, "benchmark")


def resp_parse(spark, sf_dir):
    x = responses.parsed(F.col("response"))
    return _responses(spark, sf_dir).select("item_id", F.array_join(x["requirements"], "|").alias("requirements"), x["code"].alias("code"))


def resp_codellama(spark, sf_dir):
    return _responses(spark, sf_dir).select("item_id", responses.tagged_code(F.col("response")).alias("code"))


def resp_stop_strings(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", tx.before_stops(F.col("text"), ("\n", ". ")).alias("text"))


def _calls(spark, sf_dir):
    return derived.view(spark, sf_dir, derived.CALLS, "part")


def call_signature(spark, sf_dir):
    return _calls(spark, sf_dir).select("call_id", calls.signature("call").alias("signature"), calls.call_name("call").alias("name"))


def call_blocks(spark, sf_dir):
    x = _responses(spark, sf_dir).select("item_id", responses.tagged_code(F.col("response")).alias("code"))
    return x.select("item_id", calls.code_blocks("code").alias("blocks"), calls.defined_names("code").alias("names"), calls.calls_example("code", F.lit("f")).alias("has_example"))


def call_from_assert(spark, sf_dir):
    return _calls(spark, sf_dir).select("call_id", responses.asserted_call(F.col("call")).alias("inner_call"))


def call_uncast(spark, sf_dir):
    return _calls(spark, sf_dir).select("call_id", responses.uncast(F.col("call")).alias("inner_call"))


def call_unbracket(spark, sf_dir):
    return _calls(spark, sf_dir).select("call_id", responses.without_brackets(F.col("call")).alias("inner_call"))


def ident_sanitise(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", "[ \n]")).alias("word")).distinct()
    return words.select("word", tx.identifier(F.col("word")).alias("name"))


def _qa(spark, sf_dir):
    return chat.with_history(chat.qa_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def chat_history_k3(spark, sf_dir):
    flat = F.array_join(F.transform("history", lambda p: F.concat(p["question"], F.lit("|"), p["answer"])), "~")
    return _qa(spark, sf_dir).select("conv_id", "turn", F.size("history").alias("n"), flat.alias("history"), "original", "last_question")


def chat_messages(spark, sf_dir):
    m = chat.messages(F.col("history"), F.col("question"), F.array(F.col("original")))
    return _qa(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "~").alias("messages"))


def chat_system_prompt(spark, sf_dir):
    return _qa(spark, sf_dir).select("conv_id", "turn", chat.system_prompt(F.lit(SYSTEM), F.col("history"), F.col("original")).alias("prompt"))


def chat_flat(spark, sf_dir):
    return _qa(spark, sf_dir).select("conv_id", "turn", chat.flat_history(F.col("history"), F.col("original")).alias("text"))


def _conversations(spark, sf_dir):
    return chat.conversation_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def chat_template(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", chat.templated(F.col("messages"), add_prompt=True).alias("text"))


def chat_dump(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", chat.dumped(F.lit(SYSTEM), F.col("messages")).alias("text"))


def ft_records(spark, sf_dir):
    return chat.qa_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", "turn", responses.tuning_text(F.col("question"), F.col("answer")).alias("text"))


def ft_log_pairs(spark, sf_dir):
    line = F.transform("messages", lambda m: F.concat(F.lit("<"), m["role"], F.lit(">"), F.replace(m["content"], F.lit("\n"), F.lit(" ")), F.lit("-----\n")))
    log = _conversations(spark, sf_dir).select("conv_id", F.array_join(line, "").alias("log"))
    pairs = responses.log_pairs(F.col("log"), "<user>([^\n]*)\n", "<assistant>([^\n]*)\n")
    return log.select("conv_id", F.posexplode(pairs).alias("k", "p")).select("conv_id", "k", "p.question", "p.answer")


def _nearest(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return retrieval.nearest(base, base.where("vec_id % 20 = 0"))


def vec_topk(spark, sf_dir):
    return _nearest(spark, sf_dir).select("qid", "vec_id", "rank")


def vec_index_topk(spark, sf_dir):
    """The rows of ``vec_topk`` by an index that is stored, and searched where it lies."""
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = VectorIndex.build(base, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    return index.nearest(base.where("vec_id % 20 = 0")).select("qid", "vec_id", "rank")


def rag_context(spark, sf_dir):
    found = retrieval.contexts(_nearest(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("qid", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("context_sha256"))


def doc_chunks(spark, sf_dir):
    return retrieval.chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def doc_chunks_sql(spark, sf_dir):
    """The rows of ``doc_chunks`` by a table function."""
    retrieval.register_splitter(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql("SELECT d.doc_id, c.chunk_no, c.chunk FROM {docs} d, LATERAL split_text(d.text) c", docs=docs)


def text_wrap(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", tx.wrapped(F.col("text")).alias("text"))


def name_allowed(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.replace("c_name", F.lit("#"), F.lit(" "))).when(F.col("c_custkey") % 3 == 1, F.replace("c_name", F.lit("#"), F.lit(":"))).otherwise(F.col("c_name")).alias("name"))
    return names.select("c_custkey", tx.is_allowed(F.col("name")).alias("allowed"), tx.shell_quoted(F.col("name")).alias("quoted"))


def model_tag(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    named = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit(":7b"))).otherwise(F.concat(F.lit("lab/"), F.col("p_brand")))
    return parts.select("p_partkey", tx.tagged(named).alias("model"), tx.path_safe(named).alias("file"))


def program_text(spark, sf_dir):
    x = responses.parsed(F.col("response"))
    text = tx.program(x["code"], F.lit("def check(f):\n    assert f() == 1"), F.lit("f"))
    return _responses(spark, sf_dir).select("item_id", F.sha2(text, 256).alias("program_sha256"), tx.requirements_file(x["requirements"]).alias("requirements_file"))


def data_positions(spark, sf_dir):
    """Positions of the rows in the order of their ids, in however many files and splits they are."""
    return io.positions_by(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), F.col("doc_id").asc_nulls_last()).select("doc_id", F.col("_pos").alias("position"))


def data_keys(spark, sf_dir):
    record = F.from_json("props", "map<string,string>")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", io.has_keys(record, ("k",)).alias("has_k"), io.has_keys(record, ("k", "other")).alias("has_both"))


def data_selection(spark, sf_dir):
    loaders = {name: lambda name=name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("orders", "part", "customer")}
    picked = [rows.agg(F.lit(k).alias("place"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for k, (name, rows) in enumerate(io.selected(loaders, ("part", "orders")))]
    return picked[0].unionByName(picked[1])


def data_projection(spark, sf_dir):
    return io.projected(_log(spark, sf_dir), ["status", "library", "task"])


def data_mapped(spark, sf_dir):
    def process(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.utf8_upper(batch.column("lang")), pc.cast(pc.utf8_length(batch.column("text")), pa.int64())], ["doc_id", "lang", "n_chars"])

    return io.mapped(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"), process, "doc_id long, lang string, n_chars long")


LETTERS = "aeiounrstl"


def _letter_counts(texts: list[str]) -> np.ndarray:
    return np.array([[t.count(c) for c in LETTERS] for t in texts], np.float32).reshape(len(texts), len(LETTERS))


def vec_embed(spark, sf_dir):
    """Texts through an embedder that counts letters: any other one takes its place."""
    return retrieval.embedded(spark.read.parquet(f"{sf_dir}/documents.parquet"), _letter_counts).select(F.col("vec_id").alias("doc_id"), F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("embedding"))


def rag_answer(spark, sf_dir):
    """Contexts through a generator that tells their length and has no answer for some."""

    def generate(batches):
        for batch in batches:
            size = pc.utf8_length(batch.column("context"))
            told = pc.binary_join_element_wise("characters: ", pc.cast(size, pa.string()), "")
            odd = pc.equal(pc.bit_wise_and(batch.column("qid"), pa.scalar(1, pa.int64())), 1)
            yield pa.RecordBatch.from_arrays([batch.column("qid"), pc.if_else(odd, None, told)], ["qid", "answer"])

    asked = retrieval.contexts(_nearest(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("qid", F.floor(F.col("qid") / 20).cast("long"))
    return retrieval.answered(asked, generate, "qid long, answer string")


def _pulls(spark, sf_dir):
    return derived.view(spark, sf_dir, derived.PULLS, "events").withColumnRenamed("happened", "at")


def pull_progress(spark, sf_dir):
    return progress.latest(_pulls(spark, sf_dir)).select("model", "status", rounded(F.col("percent"), 6).alias("percent"), rounded(F.col("mb"), 6).alias("mb"))


def pull_interventions(spark, sf_dir):
    return progress.interventions(_pulls(spark, sf_dir), [30.0, 60.0, 90.0]).select("model", "intervention", "target", rounded(F.col("actual"), 6).alias("actual"))


def _told(spark, sf_dir):
    """Downloads whose end is told now and then, in the order of time."""
    return _pulls(spark, sf_dir).withColumn("status", F.when(F.col("completed") >= 985 * 1048576, "success").otherwise(F.col("status")))


def pull_rounds(spark, sf_dir):
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})").alias(c)
    return progress.rounds(_told(spark, sf_dir), "1 hour").select("model", micros("began"), micros("ended"), "n", rounded(F.col("top"), 6).alias("top"), "done")


def pull_retries(spark, sf_dir):
    return progress.retried(progress.rounds(_told(spark, sf_dir), "1 hour")).select("model", "outcome", "rounds", rounded(F.col("top"), 6).alias("top"))


def pull_fallback(spark, sf_dir):
    events = _told(spark, sf_dir)
    return progress.fallback(events, progress.interventions(events, [30.0, 60.0, 90.0]), 7200)


def chat_template_pieces(spark, sf_dir):
    """The default template in pieces; these conversations are short, so each has one."""
    return chat.rendered_pieces(spark.read.parquet(f"{sf_dir}/conversations.parquet"), add_prompt=True)


def ft_pairs_all(spark, sf_dir):
    return responses.paired_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def chat_merged_system(spark, sf_dir):
    merged = chat.merged_system(F.lit(SYSTEM), F.col("messages"))
    return _conversations(spark, sf_dir).select("conv_id", F.size(merged).alias("n"), F.get(merged, F.lit(0))["content"].alias("first"))


def chat_prompt_switch(spark, sf_dir):
    return derived.view(spark, sf_dir, derived.RUNS, "lineitem").select("task", "attempt", chat.chosen_prompt(F.col("attempt") > 0, " Write the program.\n", "\nMend the program. ").alias("prompt"))


QUERIES: tuple[Query, ...] = (
    ddi_pass_counts, ddi_influence, ddi_norm_effectiveness, ddi_overall, ddi_summary_lines, ddi_fit, ddi_thresholds, ddi_decay_curve, ddi_result,
    run_status, fresh_start_sessions, dataset_subset, result_schema_dispatch,
    err_tracebacks, err_type, err_target_only, err_test_case, err_name_line, err_is_unittest, err_unittest_summary, err_prompt,
    resp_parse, resp_codellama, resp_stop_strings, call_signature, call_blocks, call_from_assert, call_uncast, call_unbracket, ident_sanitise,
    chat_history_k3, chat_messages, chat_system_prompt, chat_flat, chat_template, chat_dump, ft_records, ft_log_pairs,
    vec_topk, vec_index_topk, rag_context, doc_chunks, doc_chunks_sql, text_wrap, name_allowed, model_tag, program_text,
    data_positions, data_keys, data_selection, data_projection, data_mapped, vec_embed, rag_answer, pull_progress, pull_interventions, pull_rounds, pull_retries, pull_fallback, chat_template_pieces, ft_pairs_all, chat_merged_system, chat_prompt_switch,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (*QUERIES, *arriving.QUERIES, *stored.QUERIES)}


def oracle_sql() -> dict[str, str]:
    sql = oracles.all_sql() | stored.SQL
    return sql | {name: sql[other] for name, other in arriving.SAME_AS.items()}
