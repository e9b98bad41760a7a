"""Usage telemetry: retries, enrichment, benchmark summaries and scenario evaluation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LARGE, RETRY_SECONDS, RETRY_CALLS = 20, 60, 20


def _seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6


def retries(calls: DataFrame, within_seconds: float | None = RETRY_SECONDS, within_calls: int | None = RETRY_CALLS) -> DataFrame:
    """Calls with ``is_retry``: the session's nearest earlier call of the same tool found nothing, and is near enough.

    No window holds a whole session: calls are put in order within an hour, and what the hours before
    come to (their number of calls, and the last call of each tool) is carried over by windows of one row an hour.
    """
    c = calls.withColumn("__h", F.coalesce(F.date_trunc("hour", "ts").cast("timestamp"), F.lit("1970-01-01").cast("timestamp")))
    per = c.groupBy("session", "__h").agg(F.count(F.lit(1)).alias("__m"))
    before = W.partitionBy("session").orderBy("__h").rowsBetween(W.unboundedPreceding, -1)
    same = lambda *cs: reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"__{x}2")) for x in cs])
    base = per.select(F.col("session").alias("__session2"), F.col("__h").alias("____h2"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__base"))
    c = c.withColumn("__r", F.row_number().over(W.partitionBy("session", "__h").orderBy("ts", "call_id"))).join(base, same("session", "__h")).drop("__session2", "____h2").withColumn("nth", F.col("__base") + F.col("__r"))
    state = F.struct("result_count", "ts", "nth")
    last = c.groupBy("session", "tool", "__h").agg(F.max_by(state, F.struct("nth")).alias("__last"))
    carried = last.select(F.col("session").alias("__session2"), F.col("tool").alias("__tool2"), F.col("__h").alias("____h2"), F.lag("__last").over(W.partitionBy("session", "tool").orderBy("__h")).alias("__carried"))
    here = F.lag(state).over(W.partitionBy("session", "tool", "__h").orderBy("nth"))
    c = c.withColumn("__p", here).join(carried, same("session", "tool", "__h")).withColumn("p", F.coalesce("__p", "__carried"))
    near = F.lit(True)
    if within_seconds is not None:
        near &= _seconds(F.col("ts"), F.col("p.ts")) <= within_seconds
    if within_calls is not None:
        near &= F.col("nth") - F.col("p.nth") <= within_calls
    return c.withColumn("is_retry", F.coalesce((F.col("p.result_count") == 0) & near, F.lit(False))).select(*calls.columns, "is_retry")


def usage_summary(calls: DataFrame) -> DataFrame:
    """One row per tool: calls, empty, large and retried, shares in percent (1 digit)."""
    n = lambda c: F.count(F.when(c, 1))
    share = lambda c: F.round(100.0 * n(c) / F.count(F.lit(1)), 1)
    return retries(calls, None, None).groupBy("tool").agg(
        F.count(F.lit(1)).alias("n_calls"), n(F.col("result_count") == 0).alias("n_empty"), n(F.col("result_count") > LARGE).alias("n_large"), n(F.col("is_retry")).alias("n_retries"),
        share(F.col("result_count") == 0).alias("percent_empty"), share(F.col("result_count") > LARGE).alias("percent_large"),
    )


def per_tool_time(calls: DataFrame) -> DataFrame:
    """(tool, seconds_per_result) over calls that found something."""
    got = calls.filter("result_count > 0")
    return got.groupBy("tool").agg(F.round(F.sum("wall") / F.sum("result_count"), 6).alias("seconds_per_result"))


def top_values(rows: DataFrame, group: str, value: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of each group, ties by value."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), value))).filter(F.col("r") <= k).drop("r")


def fallback_counts(patterns: DataFrame, symbols: DataFrame) -> DataFrame:
    """(pattern, n_exact, n_any_case): how many symbols the last component of a failed pattern has."""
    names = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("name_lc").alias("lc"))
    last = patterns.select("pattern", F.substring_index("pattern", "::", -1).alias("last"))
    exact = last.join(names.select(F.col("name").alias("last"), F.col("n").alias("n_exact")), "last", "left")
    lower = names.groupBy("lc").agg(F.sum("n").alias("n_any_case"))
    return exact.withColumn("lc", F.lower("last")).join(lower, "lc", "left").select("pattern", F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_any_case", F.lit(0)).alias("n_any_case"))


def error_rates(calls: DataFrame, window: str = "5 minutes") -> DataFrame:
    """(start, n_calls, n_errors, window_rate, lifetime_rate): errors of each window against its calls and all so far."""
    per = calls.groupBy(F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n_calls"), F.count(F.when(F.col("tool") == "error", 1)).alias("n_errors"))
    # Windows are few: one row each, so a running sum over them is small.
    so_far = F.sum("n_calls").over(W.orderBy("w.start").rowsBetween(W.unboundedPreceding, 0))
    return per.select(F.col("w.start").alias("start"), "n_calls", "n_errors", F.round(F.col("n_errors") / F.col("n_calls"), 6).alias("window_rate"), F.round(F.col("n_errors") / so_far, 6).alias("lifetime_rate"))


# --- benchmark records ----------------------------------------------------

def success() -> Column:
    """No error, at least one call, and not all calls empty."""
    return F.col("error").isNull() & (F.col("total_tool_calls") > 0) & ~((F.size("counts") > 0) & F.forall("counts", lambda x: x == 0))


def model_summary(records: DataFrame) -> DataFrame:
    ok = F.when(success(), 1.0).otherwise(0.0)
    return records.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(ok), 1).alias("success_percent"), F.round(F.avg("total_tool_calls"), 2).alias("avg_calls"), F.round(F.avg("wall"), 2).alias("avg_wall"), F.sum("tokens").alias("tokens")
    )


def category_summary(records: DataFrame) -> DataFrame:
    """Success by category and model, with the totals of each category (model null) and of all."""
    ok = F.when(success(), 1.0).otherwise(0.0)
    return records.rollup("category", "model_id").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(ok), 1).alias("success_percent"), F.grouping_id().cast("int").alias("level"))


def query_matrix(records: DataFrame, models: list[str]) -> DataFrame:
    """ERR, NONE, OK or FAIL of each query and model; the last record counts."""
    state = F.when(F.col("error").isNotNull(), "ERR").when(F.col("total_tool_calls") == 0, "NONE").when(success(), "OK").otherwise("FAIL")
    return records.withColumn("state", state).groupBy("query_id").pivot("model_id", models).agg(F.max_by("state", "seq"))


def failure_labels(records: DataFrame) -> DataFrame:
    """(seq, label): why a record failed; several labels give several rows."""
    err = F.col("error")
    first = F.when(err.isNotNull(), F.when(err.contains("connection_error"), "connection_error").when(err.contains("max_tokens"), "max_tokens_exceeded").when(err.contains("json_decode"), "json_decode_error").otherwise("other_error")).when(F.col("total_tool_calls") == 0, "no_tool_calls")
    p = F.col("pattern")
    labels = F.array_compact(
        F.array(
            F.when(F.coalesce(p, F.lit("")) == "", "empty_pattern"),
            F.when(p.rlike(r"\(.*\)|\bconst\b.*&|\b(?:void|bool|int)\b\s+\w+"), "signature_in_pattern"),
            F.when(p.rlike(r"^\w+(?:::\w+)+$"), "qualified_name_as_pattern"),
            F.when(F.array_contains("counts", F.lit(0).cast("long")) & ~F.exists("counts", lambda x: x > 0), "empty_results_no_retry"),
            F.when(F.array_contains("counts", F.lit(0).cast("long")) & (p.startswith("^") | p.endswith("$")), "wrong_regex"),
        )
    )
    return records.select("seq", F.explode(F.when(first.isNotNull(), F.array(first)).otherwise(labels)).alias("label"))


def tool_differences(records: DataFrame) -> DataFrame:
    """(seq, missing, extra): expected tools not called and called ones not expected, as text."""
    diff = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return records.select("seq", diff("expected", "called").alias("missing"), diff("called", "expected").alias("extra"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(scenario_id, verdict): fixed, broken, same, new or gone."""
    a, b = before.select("scenario_id", F.col("passed").alias("a")), after.select("scenario_id", F.col("passed").alias("b"))
    verdict = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(~F.col("a") & F.col("b"), "fixed").when(F.col("a") & ~F.col("b"), "broken").otherwise("same")
    return a.join(b, "scenario_id", "full_outer").select("scenario_id", verdict.alias("verdict"))


def tool_frequency(records: DataFrame) -> DataFrame:
    """(tool, n_called, n_expected, match_rate): how often each tool was called and expected, and how often both at once, of the times expected (3 digits)."""
    one = lambda c, name: records.select("seq", F.explode(F.array_distinct(c)).alias("tool"), F.lit(1).alias(name))
    met = one("called", "c").unionByName(one("expected", "e"), allowMissingColumns=True).groupBy("seq", "tool").agg(F.max("c").alias("c"), F.max("e").alias("e"))
    n = met.groupBy("tool").agg(F.count("c").alias("n_called"), F.count("e").alias("n_expected"), F.count(F.when(F.col("c").isNotNull() & F.col("e").isNotNull(), 1)).alias("both"))
    return n.select("tool", "n_called", "n_expected", F.when(F.col("n_expected") > 0, F.round(F.col("both") / F.col("n_expected"), 3)).alias("match_rate"))


def failure_examples(records: DataFrame, k: int = 3) -> DataFrame:
    """(label, model_id, n, examples): failures of each model, with the first ``k`` sequence numbers as text.

    Every part of 1,024 hash slots gives its own first ``k``, so no window holds all failures of a label.
    """
    met = failure_labels(records).join(records.select("seq", "model_id"), "seq").withColumn("slot", F.pmod(F.xxhash64("seq"), F.lit(1024)))
    first = lambda df, *by: df.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("seq"))).filter(F.col("r") <= k).drop("r")
    top = first(first(met, "label", "model_id", "slot"), "label", "model_id").groupBy("label", "model_id").agg(F.array_join(F.array_sort(F.collect_list("seq")), ",").alias("examples"))
    return met.groupBy("label", "model_id").agg(F.count(F.lit(1)).alias("n")).join(top, ["label", "model_id"])


def runaway_loops(calls: DataFrame, limit: int = 5) -> DataFrame:
    """(session, tool, first_call, n): stretches in which a session calls one tool ``limit`` times or more without another between."""
    by = W.partitionBy("session").orderBy("ts", "call_id")
    c = calls.withColumn("nth", F.row_number().over(by)).withColumn("new", F.coalesce((F.lag("tool").over(by) != F.col("tool")).cast("int"), F.lit(1)))
    c = c.withColumn("stretch", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    got = c.groupBy("session", "stretch", "tool").agg(F.min_by("call_id", "nth").alias("first_call"), F.count(F.lit(1)).alias("n"))
    return got.filter(F.col("n") >= limit).select("session", "tool", "first_call", "n")


def error_summary(calls: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """(kind, operation, n): errors in the last ``seconds`` before ``now`` (microseconds) by kind and by whether they gave data."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    recent = calls.filter((F.col("tool") == "error") & (at <= now) & (at > now - seconds * 1_000_000))
    return recent.groupBy(F.col("tool").alias("kind"), F.when(F.col("result_count") == 0, "empty").otherwise("data").alias("operation")).agg(F.count(F.lit(1)).alias("n"))


def enriched(calls: DataFrame, pattern: str = "pattern", large: int = LARGE) -> DataFrame:
    """Calls with what the log adds to them: is_empty, is_large, is_retry and the class of their pattern."""
    from ..functions.patterns import pattern_class

    c = retries(calls)
    return c.withColumns({"is_empty": F.col("result_count") == 0, "is_large": F.col("result_count") > large, "pattern_class": pattern_class(F.col(pattern))})


def alternative_names(patterns: DataFrame, symbols: DataFrame, k: int = 3) -> DataFrame:
    """(pattern, names): the first ``k`` names that equal the last component of a pattern in any case."""
    names = symbols.filter("name IS NOT NULL").select("name", F.col("name_lc").alias("lc")).distinct()
    top = names.withColumn("r", F.row_number().over(W.partitionBy("lc").orderBy("name"))).filter(F.col("r") <= k)  # as many as ways to write a name
    top = top.groupBy("lc").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return patterns.select("pattern", F.lower(F.substring_index("pattern", "::", -1)).alias("lc")).join(top, "lc").select("pattern", "names")


def unwrapped(arguments: Column) -> Column:
    """Arguments that are nothing but ``parameters`` with an object in it, as that object (JSON texts)."""
    inner = F.get_json_object(arguments, "$.parameters")
    alone = F.json_array_length(F.to_json(F.call_function("json_object_keys", arguments))) == 1
    return F.when(alone & inner.startswith("{"), inner).otherwise(arguments)


def response_records(responses: DataFrame) -> DataFrame:
    """(response_id, n_calls, tools, error, text) of model responses ``body`` (JSON with output items); a stop for length is an error."""
    schema = "struct<output array<struct<type string, name string, text string, arguments string>>, stop_reason string, error string>"
    b = F.from_json("body", schema)
    calls = F.filter(F.coalesce(b["output"], F.array().cast("array<struct<type string, name string, text string, arguments string>>")), lambda x: x["type"] == "function_call")
    words = F.filter(F.coalesce(b["output"], F.array().cast("array<struct<type string, name string, text string, arguments string>>")), lambda x: x["type"] == "message")
    error = F.when(b["error"].isNotNull(), b["error"]).when(b["stop_reason"] == "max_tokens", "max_tokens")
    return responses.select("response_id", F.size(calls).alias("n_calls"), F.array_join(F.transform(calls, lambda x: x["name"]), ",").alias("tools"), error.alias("error"), F.array_join(F.transform(words, lambda x: x["text"]), "\n").alias("text"))


def compact_report(failures: DataFrame) -> DataFrame:
    """(label, category, n, first_seq): failures by their label and category, the most frequent first."""
    return failures.groupBy("label", "category").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def fixture_holds(spec: Column, actual: Column) -> Column:
    """Does a value fit a fixture's spec: ``contains:x``, ``regex:x`` (found anywhere), or else equal; all in any case."""
    got, kind, want = F.coalesce(actual, F.lit("")), F.substring_index(spec, ":", 1), F.substring(spec, F.instr(spec, ":") + 1, F.length(spec))
    found = F.call_function("rlike", got, F.concat(F.lit("(?i)"), want))
    return F.coalesce(actual.isNotNull() & F.when(spec.startswith("contains:"), F.lower(got).contains(F.lower(want))).when(spec.startswith("regex:"), found).otherwise(F.lower(got) == F.lower(spec)), F.lit(False))


# --- scenario evaluation --------------------------------------------------

def assertion_holds(kind: Column, expected: Column, actual: Column) -> Column:
    """any, absent, exact, contains, regex and one_of (values parted by ``|``), in any case."""
    got, want = F.lower(F.coalesce(actual, F.lit(""))), F.lower(expected)
    return F.coalesce(
        F.when(kind == "any", actual.isNotNull()).when(kind == "absent", actual.isNull()).when(kind == "exact", got == want).when(kind == "contains", got.contains(want))
        .when(kind == "regex", F.call_function("rlike", F.coalesce(actual, F.lit("")), F.concat(F.lit("(?i)"), expected))).when(kind == "one_of", F.array_contains(F.split(want, r"\|"), got)),
        F.lit(False),
    )


def failure_pattern(missing: Column, tool_match: Column, params_pass: Column) -> Column:
    return F.when(tool_match & params_pass, None).when(missing, "missing_call").when(~tool_match, "wrong_tool").otherwise("wrong_param")


def best_fixtures(calls: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(call_id, fixture_id): of the fixtures whose criteria all hold, the one with the most, then the first.

    ``calls``: call_id, tool, args map; ``fixtures``: fixture_id, tool, pos, criteria map (see ``fixture_holds``).
    """
    holds = F.forall(F.map_entries("criteria"), lambda e: fixture_holds(e["value"], F.col("args")[e["key"]]))
    met = calls.join(fixtures, "tool").filter((F.size("criteria") > 0) & holds)
    return met.groupBy("call_id").agg(F.max_by("fixture_id", F.struct(F.size("criteria"), -F.col("pos"))).alias("fixture_id"))


def aligned(expected: list[dict], calls: list[dict], relaxed: bool = False, discovery: frozenset[str] = frozenset()) -> list[dict]:
    """Expected steps (tool, optional) against recorded calls (tool), greedily and in order."""
    out, k = [], 0
    for i, want in enumerate(expected, 1):
        while relaxed and k < len(calls) and calls[k]["tool"] in discovery and calls[k]["tool"] != want["tool"]:
            k += 1
        there = k < len(calls)
        match = there and calls[k]["tool"] == want["tool"]
        used = match or there and not want.get("optional", False)
        out.append({"step": i, "expected_tool": want["tool"], "actual_tool": calls[k]["tool"] if used else None, "tool_match": match, "skipped": not used and want.get("optional", False), "missing": not there and not want.get("optional", False)})
        k += used
    return out


def align_scenarios(expected: DataFrame, calls: DataFrame, relaxed: bool = False, discovery: tuple[str, ...] = ()) -> DataFrame:
    """``aligned`` for every scenario: the steps and calls of one scenario meet in one task, as their order matters.

    ``expected``: scenario_id, pos, tool, optional; ``calls``: scenario_id, pos, tool.
    """
    told = frozenset(discovery)

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        steps = [{"tool": t, "optional": bool(o)} for t, o in a.sort_values("pos")[["tool", "optional"]].itertuples(index=False)]
        rows = aligned(steps, [{"tool": t} for t in b.sort_values("pos")["tool"]], relaxed, told)
        return pd.DataFrame([{"scenario_id": key[0], **r} for r in rows], columns=["scenario_id", "step", "expected_tool", "actual_tool", "tool_match", "skipped", "missing"])

    schema = "scenario_id long, step int, expected_tool string, actual_tool string, tool_match boolean, skipped boolean, missing boolean"
    return expected.groupBy("scenario_id").cogroup(calls.groupBy("scenario_id")).applyInPandas(run, schema)


# --- conversations --------------------------------------------------------

def tool_steps(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, tool_name, n_results, reasoning): tool requests paired with the result that answers them.

    Of several requests before a result the last one counts; text in between resets it.
    """
    from .nested import latest_readable, read_object
    from .nested import _list as as_list

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for conv, text in zip(b["conv_id"], b["raw_json"]):
                seq, pending, thought = 0, None, None
                for m in as_list(read_object(text).get("messages")):
                    for v in as_list(m.get("versions")) if isinstance(m, dict) else []:
                        for s in as_list(v.get("steps")) if isinstance(v, dict) else []:
                            for c in as_list(s.get("content")) if isinstance(s, dict) else []:
                                kind = c.get("type") if isinstance(c, dict) else None
                                if kind == "toolCallRequest":
                                    pending = c.get("name")
                                elif kind == "toolCallResult":
                                    if pending is not None:
                                        body = str(c.get("content"))
                                        out.append((conv, seq, str(pending), len(re.findall(r'name\\*"\s*:', body)), thought))
                                        seq += 1
                                    pending = thought = None
                                elif kind == "text":
                                    thought, pending = str(c.get("text")).encode("utf-8", "replace").decode(), None
            yield pd.DataFrame(out, columns=["conv_id", "seq", "tool_name", "n_results", "reasoning"])

    return latest_readable(conversations).mapInPandas(run, "conv_id long, seq int, tool_name string, n_results int, reasoning string")


def result_count(text: Column) -> Column:
    """How many results a JSON answer holds: a list's length, else that of results or data, else callers and
    callees, else ``count``, else 1 for any other object; null if it cannot be read."""
    v = F.call_function("try_parse_json", text)
    size = lambda path: F.size(F.try_variant_get(v, path, "array<variant>"))
    calls = F.coalesce(size("$.callers"), F.lit(0)) + F.coalesce(size("$.callees"), F.lit(0))
    return F.coalesce(
        size("$"), size("$.results"), size("$.data"), F.when(size("$.callers").isNotNull() | size("$.callees").isNotNull(), calls), F.try_variant_get(v, "$.count", "int"), F.when(F.call_function("schema_of_variant", v).startswith("OBJECT"), 1)
    )


def pass_rates(results: DataFrame, group: str = "category") -> DataFrame:
    """(group, n, passed, pass_rate with 3 digits) of scenario results (passed)."""
    return results.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.round(F.avg(F.col("passed").cast("int")), 3).alias("pass_rate"))


def expanded_scenarios(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, query): one row for each of a scenario's ``queries``, numbered ``id/k`` where there are several."""
    many = scenarios.select("scenario_id", F.size("queries").alias("k"), F.posexplode("queries").alias("i", "query"))
    return many.select(F.when(F.col("k") > 1, F.concat_ws("/", "scenario_id", (F.col("i") + 1).cast("string"))).otherwise(F.col("scenario_id")).alias("scenario_id"), "query")


def chosen(records: DataFrame, ids: list[str] | None = None, categories: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """Records of the given query ids (any case), categories (a name or its first letter) and models (parts of names)."""
    ok = F.lit(True)
    if ids:
        ok &= F.upper("query_id").isin([x.upper() for x in ids])
    if categories:
        ok &= F.upper("category").isin([x.upper() for x in categories]) | F.upper(F.substring("query_id", 1, 1)).isin([x.upper() for x in categories])
    if models:
        hit = F.lit(False)
        for m in models:
            hit |= F.lower("model_id").contains(m.lower())
        ok &= hit
    return records.filter(ok)


def tool_descriptions(tool_nodes: DataFrame) -> DataFrame:
    """(tool_name, description) of the tools that conversations name; the first by conversation and path."""
    name, text = F.coalesce(F.get_json_object("body", "$.function.name"), F.get_json_object("body", "$.name")), F.coalesce(F.get_json_object("body", "$.function.description"), F.get_json_object("body", "$.description"))
    return tool_nodes.filter("node_level = 'tool'").select(name.alias("tool_name"), text.alias("description"), "conv_id", "node_path").filter("tool_name IS NOT NULL").groupBy("tool_name").agg(F.min_by("description", F.struct("conv_id", "node_path")).alias("description"))


def conversation_text(content_nodes: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv_id, line_path, line): the contents of conversations as lines of Markdown, to be read in order of path."""
    kind, text = F.get_json_object("body", "$.type"), F.get_json_object("body", "$.text")
    line = F.when(kind == "toolCallRequest", F.concat(F.lit("**call** `"), F.get_json_object("body", "$.name"), F.lit("` "), F.coalesce(F.get_json_object("body", "$.parameters"), F.lit("")))).when(
        kind == "toolCallResult", F.concat(F.lit("**result** "), F.coalesce(F.get_json_object("body", "$.content"), F.lit("")))
    ).otherwise(text)
    return content_nodes.filter("node_level = 'content'").select(conv, F.col("node_path").alias("line_path"), line.alias("line")).filter("line IS NOT NULL")
