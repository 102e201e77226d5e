"""From source files to completion tasks, and from tasks and answers to the tasks that are kept, as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegrain.functions.comments import strip_comments_by
from codegrain.functions.text import code_tokens, masked, uniform
from codegrain.operators.nodes import classify, exploded, grain, perturbed, project_modules, python_imports, sample_nodes, with_nodes
from codegrain.operators.paths import ratios
from codegrain.operators.quality import first_n, in_band, passes_gate, weighted_choice
from codegrain.operators.relevance import context, context_code
from codegrain.operators.retrieval import context_top
from codegrain.operators.skeletons import class_skeleton_udf, function_skeleton_udf
from codegrain.operators.topup import numbered, picked, top_up
from codegrain.plans.score import scored
from codegrain.sources.shared import scratch


def stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grained_nodes(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(file, grain, sub_task, id, start_byte, end_byte), stored: the nodes of files (file, language, code) that have a grain."""
    nodes = classify(exploded(with_nodes(files.select("file", "language", "code")).drop("code")), symbols)
    of, label = grain(F.col("category"), F.col("tag"))
    return stored(nodes.withColumns({"grain": of, "sub_task": label}).where("grain is not null").select("file", "grain", "sub_task", "id", "start_byte", "end_byte"))


def drawn_nodes(files: DataFrame, attempts: int = 3, seed: int = 7, levels: tuple[str, ...] = (), symbols: DataFrame | None = None) -> DataFrame:
    """(file, attempt, grain, sub_task, start_byte, end_byte) for files (file, language, code): every file gets `attempts`
    draws of a node for each grain it has, of the levels named if any; the node or a part of it is what will be masked.

    Files are parsed once and their nodes stored; all attempts are drawn in one pass over them.
    """
    slim = grained_nodes(files, symbols)
    wanted = [g for level in levels for g, share in ratios(level).items() if share]
    some = slim.where(F.col("grain").isin(wanted)) if levels else slim
    tried = some.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    return perturbed(sample_nodes(tried, ["file", "grain", "attempt"], seed), slim, "file", seed=seed, also=("grain", "attempt")).drop("id")


def _shown(drawn: DataFrame) -> DataFrame:
    """drawn (language, grain, code, start_byte, end_byte, ...) cut into prefix, middle and suffix, with skeleton: those whose
    middle passes the gate of its grain and that have the skeleton they need."""
    cut = drawn.withColumn("mask", masked(F.col("code"), F.col("start_byte"), F.col("end_byte"))).select("*", "mask.*")
    clean = cut.withColumn("middle", strip_comments_by(F.col("middle"), F.col("language"))).where(passes_gate(F.col("middle"), F.col("grain")))
    skeleton = F.when(F.col("grain") == "class", class_skeleton_udf()("middle", "language")).when(F.col("grain") == "function", function_skeleton_udf()("middle", "language"))
    return clean.withColumn("skeleton", skeleton).where("grain in ('block', 'line') or skeleton is not null")


TASK = ("repo_name", "path", "language", "grain", "sub_task", "attempt", "prefix", "middle", "suffix", "skeleton")


def topped_up_tasks(files: DataFrame, per_repo: int = 5, factor: int = 3, seed: int = 7, weights: dict[str, float] | None = None, symbols: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tasks, report): per_repo tasks of each repository, drawn in rounds until it has them or has had per_repo * factor
    attempts; the columns of tasks(), and (repo_name, kept, drawn, rounds).

    An attempt draws a file among those of the repository that have a node of any grain with a weight, a grain by weight
    (equal by default) among those that the file has, and one of its nodes of that grain, then goes the way of tasks(). Equal
    middles of a repository count once, by their first attempt. Every draw is a hash, so rounds and reruns agree.
    """
    weights = {g: w for g, w in (weights or dict.fromkeys(("class", "function", "block", "line"), 1.0)).items() if w > 0}
    keyed = files.withColumn("file", F.concat_ws("/", "repo_name", "path"))
    every = grained_nodes(keyed, symbols)
    some = every.where(F.col("grain").isin(*weights))
    counts = some.groupBy("file").agg(*(F.count_if(F.col("grain") == g).alias(f"n_{g}") for g in weights))
    placed_files = numbered(counts.join(keyed.select("repo_name", "file"), "file"), ["repo_name"], ["file"])
    placed_nodes = numbered(some, ["file", "grain"], ["start_byte", "id"])
    u = lambda what: uniform(F.col("repo_name"), F.col("attempt"), F.lit(what), F.lit(seed))

    def draw(asked: DataFrame) -> DataFrame:
        of = picked(asked, placed_files, ["repo_name"], u("file"))
        of = of.withColumn("grain", weighted_choice(weights, {g: F.col(f"n_{g}") for g in weights}, F.col("repo_name"), F.col("attempt"), F.lit("grain"), F.lit(seed)))
        nodes = picked(of.select("repo_name", "attempt", "file", "grain"), placed_nodes, ["file", "grain"], u("node"))
        parts = perturbed(nodes, every, "file", seed=seed, also=("attempt",)).drop("id")
        return _shown(parts.join(keyed.drop("repo_name"), "file")).select(*TASK)

    kept, report = top_up(placed_files.select("repo_name").distinct(), draw, per_repo, per_repo * factor, unlike="middle")
    return kept.select(F.concat_ws(":", "repo_name", "path", "grain", "attempt").alias("sample_id"), *TASK), report


def tasks(files: DataFrame, per_repo: int | None = 5, attempts: int = 3, seed: int = 7, levels: tuple[str, ...] = (), symbols: DataFrame | None = None) -> DataFrame:
    """(repo_name, path, language, code) as tasks (sample_id, repo_name, path, language, grain, sub_task, attempt, prefix,
    middle, suffix, skeleton), at most per_repo of each repository and grain (None: all).

    The middle loses its comments and must pass the gate of its grain; class and function tasks get a skeleton and go
    without one; of equal middles of a repository and grain the first attempt of the first file stays. repo_name and path
    name a file; a null code has no nodes. prefix, the masked bytes and suffix are the file.
    """
    keyed = files.withColumn("file", F.concat_ws("/", "repo_name", "path"))
    shown = _shown(drawn_nodes(keyed, attempts, seed, levels, symbols).join(keyed, "file"))
    first = F.row_number().over(Window.partitionBy("repo_name", "grain", F.md5(F.col("middle").cast("binary"))).orderBy("attempt", "file"))
    once = shown.withColumn("_first", first).where("_first = 1")
    kept = once if per_repo is None else first_n(once, ["repo_name", "grain"], ["attempt", "file"], per_repo)
    return kept.select(F.concat_ws(":", "file", "grain", "attempt").alias("sample_id"), *TASK)


def task_context(made: DataFrame, files: DataFrame, installed: tuple[str, ...] = ()) -> DataFrame:
    """(sample_id, path, relevance, rank): for each task the other files of its repository, the most relevant first: hits of
    the modules that the task's file imports and that are not installed, plus its share of BM25 over code tokens."""
    whole = F.concat("prefix", "middle", "suffix")
    queries = made.select("sample_id", F.col("repo_name").alias("repo"), "path", code_tokens(whole).alias("tokens"), project_modules(python_imports()(whole), installed).alias("modules"))
    return context(queries, files.select(F.col("repo_name").alias("repo"), "path", code_tokens(F.col("code")).alias("tokens")), F.col("modules"))


def best_context(made: DataFrame, files: DataFrame, most: int, installed: tuple[str, ...] = ()) -> DataFrame:
    """(sample_id, context_code): for each task the code of the `most` best other files of its repository, the best first, by
    import hits and then by BM25; no ranking of all files is made. Tasks without such a file have no row."""
    whole = F.concat("prefix", "middle", "suffix")
    queries = made.select("sample_id", F.col("repo_name").alias("repo"), "path", code_tokens(whole).alias("tokens"), project_modules(python_imports()(whole), installed).alias("modules"))
    held = files.where("code is not null").select(F.col("repo_name").alias("repo"), "path", "code", code_tokens(F.col("code")).alias("tokens"))
    return context_code(context_top(queries, held.drop("code"), most), held, most)


def kept_tasks(made: DataFrame, answers: DataFrame, per_repo: int | None = 5, low: float = 10, high: float = 50, raw_models: tuple[str, ...] = ()) -> DataFrame:
    """Tasks that a model neither fails outright nor solves, at most per_repo of each repository and grain, with model,
    answer, similarity and the cleaned texts that were compared.

    answers: (sample_id, model, try, answer). Of the tries of a model at a task the first that gave an answer counts, so
    retries are rows and not calls in a loop. Tasks without an answer, and answers without code, go.
    """
    tried = answers.where("length(answer) > 0").groupBy("sample_id", "model").agg(F.min_by("answer", "try").alias("answer"))
    asked = made.join(tried, "sample_id").withColumns({"fill_type": F.col("grain"), "true_code": F.col("middle")})
    good = scored(asked, raw_models).where(in_band(F.col("similarity"), low, high)).drop("fill_type", "true_code")
    return good if per_repo is None else first_n(good, ["repo_name", "grain"], ["attempt", "path", "model"], per_repo).drop("rank")


def records(kept: DataFrame, contexts: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Kept tasks as records that sources.jsonl writes and reads; contexts: (sample_id, context_code)."""
    stamp = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd HH:mm:ss")
    none = F.lit(None).cast("string")
    rows = kept if contexts is None else kept.join(contexts, "sample_id", "left")
    pairs = F.transform("context_code", lambda c: F.array(c["path"], c["code"])) if contexts is not None else F.lit(None).cast("array<array<string>>")
    of = lambda name: F.when(F.col("grain") == name, F.col("skeleton"))
    struct = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    return rows.select(
        "repo_name",
        F.col("path").alias("file_name"),
        struct(prefix_code=F.col("prefix"), suffix_code=F.col("suffix"), middle_code=F.col("middle"), code_description=none, fill_type=F.concat(F.upper("grain"), F.lit("_TYPE")), language_type=F.col("language"), sub_task_type=F.col("sub_task")).alias("inference_info"),
        pairs.alias("context_code"),
        struct(created_time=stamp, created_task_model=F.col("model"), class_skeleton=of("class"), function_skeleton=of("function"), code_description=none).alias("task_instance_info"),
        struct(inference_model=F.col("model"), inference_result=F.col("answer"), inference_time=stamp).alias("inference_content"),
        struct(edit_distance=F.col("similarity"), calculate_time=stamp, true_code_clean=F.col("true_clean"), predict_code_clean=F.col("predicted_clean")).alias("editdistance_info"),
    )
