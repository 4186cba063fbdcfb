"""Methods: scores of records by name, from whatever table the method reads; their registry, score columns and parameters."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaudit.functions import arrays as A
from lexaudit.functions import vectorised as V
from lexaudit.operators import signals as S

# --- scores from quizzes -----------------------------------------------------------------------------------------------

LETTERS = ("A", "B", "C", "D")
#: The smallest denominator of the chance correction, and the mean below which a letter counts as not preferred.
KAPPA_FLOOR, PREFERRED = 1e-3, 1 / 5


def letter_means(quiz: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by and chance, the mean probability of each letter where the original is no option (bdq: letter to probability); only finite ones count, 0 without any."""
    finite = lambda letter: F.when(A.finite(F.col("bdq")[letter]), F.col("bdq")[letter])
    means = [F.coalesce(F.avg(finite(c)), F.lit(0.0)) for c in LETTERS]
    return quiz.groupBy(*by).agg(*[m.alias(f"__{c}") for c, m in zip(LETTERS, means)]).select(*by, F.create_map(*[x for c in LETTERS for x in (F.lit(c), F.col(f"__{c}"))]).alias("chance"))


def quiz_scores(quiz: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, id and mean_pcorrect, min_pcorrect, pcorrect_kappa, pcorrect_kappa_np of quizzes (id, bdq, bcq: slot to letter to probability).

    A slot's probability is that of its own letter. Kappa corrects it by the letter's mean in the partition ``by``; kappa_np
    averages over letters that are not preferred (all, if every letter is). Records without slots are null.
    """
    chance = letter_means(quiz, by)
    rows = quiz.join(chance, list(by)) if by else quiz.crossJoin(chance)
    slots = F.filter(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col("bcq")[c][c], F.lit(0.0)).alias("p"), F.map_contains_key("bcq", c).alias("there"), F.col("chance")[c].alias("pe")) for c in LETTERS]), lambda s: s["there"])
    rare = F.filter(F.array(*[F.when(F.col("chance")[c] < PREFERRED, F.lit(c)) for c in LETTERS]), lambda c: c.isNotNull())
    kappa = lambda s: A.mean(F.transform(s, lambda x: A.kappa(x["p"], x["pe"], KAPPA_FLOOR)))
    rows = rows.select(*by, "id", slots.alias("s"), rare.alias("rare"))
    chosen = F.when(F.size("rare") == 0, F.col("s")).otherwise(F.filter("s", lambda x: F.array_contains("rare", x["c"])))
    return rows.select(*by, "id", A.mean(F.col("s.p")).alias("mean_pcorrect"), F.array_min("s.p").alias("min_pcorrect"), kappa(F.col("s")).alias("pcorrect_kappa"), kappa(chosen).alias("pcorrect_kappa_np"))


# --- scores from completions -------------------------------------------------------------------------------------------


def completion_peaks(samples: DataFrame, grid: Sequence[tuple[float, int]], xi: float = 0.01) -> DataFrame:
    """id, alpha, cap, peak, is_member from (id, greedy, samples: token arrays): the share of sampled completions, cut to ``cap`` tokens, whose edit distance to the greedy one is at most alpha times the longest."""
    caps = sorted({c for _, c in grid})

    @F.pandas_udf("array<struct<cap:int,longest:int,distances:array<int>>>")
    def distances(greedy: pd.Series, drawn: pd.Series) -> pd.Series:
        out = []
        for g, many in zip(greedy, drawn):
            cells = []
            for cap in caps:
                own, cut = list(g)[:cap], [list(x)[:cap] for x in many]
                cells.append({"cap": cap, "longest": max([len(own), *map(len, cut)]), "distances": [V.edit_distance(own, x) for x in cut]})
            out.append(cells)
        return pd.Series(out)

    cells = samples.select("id", F.explode(distances("greedy", "samples")).alias("c")).select("id", "c.*")
    alphas = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(c).alias("of")) for a, c in grid])).alias("g")
    rows = cells.select("*", alphas).where("g.of = cap")
    near = F.size(F.filter("distances", lambda d: d <= F.col("g.alpha") * F.col("longest")))
    peak = F.coalesce(F.try_divide(near.cast("double"), F.size("distances").cast("double")), F.lit(0.0))
    return rows.select("id", F.col("g.alpha").alias("alpha"), "cap", peak.alias("peak"), (peak > xi).alias("is_member"))


def guided_scores(completions: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """id, rouge_guided, rouge_general, rouge_delta and gpt4_icl of completions (id, second, guided, general: texts): overlap with the true second piece, with and without the source's name. ``judged``: id, p_yes of a judge, null if it has none."""
    tokens = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    rows = completions.select("id", V.rouge_l(tokens(F.col("second")), tokens(F.col("guided"))).alias("rouge_guided"), V.rouge_l(tokens(F.col("second")), tokens(F.col("general"))).alias("rouge_general"))
    rows = rows.withColumn("rouge_delta", F.col("rouge_guided") - F.col("rouge_general"))
    if judged is None:
        return rows.withColumn("gpt4_icl", F.lit(None).cast("double"))
    return rows.join(judged.select("id", F.col("p_yes").alias("gpt4_icl")), "id", "left")


def prefix_tokens(shots: DataFrame, n: int, mean_target: int, context: int, most: int) -> DataFrame:
    """prefix, shots: the first ``n`` texts (place, w: tokens) cut to equal shares of what the context leaves beside a target, joined; no row if nothing fits."""
    chosen = shots.where(F.col("place") < n)
    budget = max(context - mean_target, 0)
    packed = chosen.agg(F.sort_array(F.collect_list(F.struct("place", "w"))).alias("s"))
    share = F.least(F.lit(most), F.floor(F.lit(budget) / F.size("s"))).cast("int")
    return packed.where((F.size("s") > 0) & (share > 0)).select(F.flatten(F.transform("s", lambda x: F.slice(x["w"], F.lit(1), share))).alias("prefix"), F.size("s").alias("shots"))


def prefix_scores(likelihoods: DataFrame) -> DataFrame:
    """id, recall from (id, conditional, plain): mean log-probability after the prefix over that without; null if not finite."""
    return likelihoods.select("id", A.prefix_ratio(F.col("conditional"), F.col("plain")).alias("recall"))


#: What is measured before and after fine-tuning.
TUNED = ("loss", "zlib", "lowercase", "mink", "minkpp")


def tuned_deviations(base: DataFrame, tuned: DataFrame, key: Sequence[str] = ("id",), measures: Sequence[str] = TUNED) -> DataFrame:
    """key and base_<m>, ft_<m>, fsd_<m>_score (base less tuned, null unless both are finite) of each measure."""
    b, t = (df.select(*key, *[F.col(m).cast("double").alias(f"{name}_{m}") for m in measures]) for df, name in ((base, "base"), (tuned, "ft")))
    dev = lambda m: F.when(A.finite(F.col(f"base_{m}")) & A.finite(F.col(f"ft_{m}")), F.col(f"base_{m}") - F.col(f"ft_{m}")).alias(f"fsd_{m}_score")
    return b.join(t, list(key)).select(*key, *[c for m in measures for c in (F.col(f"base_{m}"), F.col(f"ft_{m}"), dev(m))])


# --- the registry ------------------------------------------------------------------------------------------------------


@dataclass
class ScoreMethod:
    """A named function from its input table to id and score columns; higher means more likely a member."""

    name: str
    reads: str  # the kind of table: stats, signals, quiz, completions, pairs, ...
    run: Callable[..., DataFrame]

    def apply(self, table: DataFrame, **options) -> DataFrame:
        """Options that the method does not take are left out, so one set can serve all methods."""
        takes = inspect.signature(self.run).parameters
        return self.run(table, **{k: v for k, v in options.items() if k in takes or any(p.kind is p.VAR_KEYWORD for p in takes.values())})


def columns(**named: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    """A method that is one projection of its table."""

    def run(table: DataFrame) -> DataFrame:
        return table.select("id", *[f().alias(c) for c, f in named.items()])

    return run


def _lp() -> Column:
    return F.col("lp")


def _mink(table: DataFrame, k: float = 0.2) -> DataFrame:
    return table.select("id", A.min_k(_lp(), k).alias("min_k_prob_mean_logprob"), A.min_k_plus(_lp(), F.col("mu"), F.col("sigma"), k).alias("min_k_pp_score"))


def _camia(table: DataFrame, composition: str = "edgington") -> DataFrame:
    return S.combine(table).select("id", F.col(composition).alias("camia_faithful_score"))


def _camia_plain(table: DataFrame, composition: str = "edgington") -> DataFrame:
    return S.combine(table).select("id", F.col(composition).alias("camia_score"))


def _neighbours(table: DataFrame, score_type: str = "d") -> DataFrame:
    d, z = A.neighbour_scores(F.col("target"), F.col("others"))
    return table.select("id", (d if score_type == "d" else z).alias("score"))


def _quiz(table: DataFrame, score_type: str = "mean_pcorrect") -> DataFrame:
    return quiz_scores(table).select("id", F.col(score_type).alias("score"))


def _peaks(table: DataFrame, alpha: float = 0.05, length_cap: int = 100) -> DataFrame:
    return completion_peaks(table, [(alpha, length_cap)]).select("id", "peak")


def _guided(table: DataFrame, score_type: str = "rouge_guided") -> DataFrame:
    return guided_scores(table).select("id", F.col(score_type).alias("score"))


@dataclass
class Registry:
    methods: dict[str, ScoreMethod] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    def add(self, method: ScoreMethod) -> None:
        self.methods[method.name] = method

    def normal(self, name: str) -> str:
        key = name.strip().lower()
        return self.aliases.get(key, key)

    def resolve(self, names: Sequence[str]) -> list[ScoreMethod]:
        """Methods of the names or aliases, each once, in order; an unknown name raises."""
        return [self.methods[k] for k in dict.fromkeys(map(self.normal, names))]

    def apply(self, names: Sequence[str], tables: Mapping[str, DataFrame], options: Mapping[str, Mapping] | None = None) -> DataFrame:
        """Long form: id, method, score_name, score. ``options`` by method, those under "*" for all; ``tables`` by what methods read."""
        out = None
        for m in self.resolve(names):
            wide = m.apply(tables[m.reads], **{**(options or {}).get("*", {}), **(options or {}).get(m.name, {})})
            scores = [c for c in wide.columns if c != "id"]
            rows = wide.select("id", F.lit(m.name).alias("method"), F.explode(F.map_from_arrays(F.array(*map(F.lit, scores)), F.array(*[F.col(c).cast("double") for c in scores]))).alias("score_name", "score"))
            out = rows if out is None else out.unionByName(rows)
        return out


def counted(scores: DataFrame, records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, num_total, num_scored, num_skipped: records (by, id) and those of them that have a score (id, score not null)."""
    have = scores.where("score is not null").select("id").distinct().withColumn("__scored", F.lit(True))
    rows = records.select(*by, "id").join(have, "id", "left")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("num_total"), F.count("__scored").alias("num_scored"), F.count_if(F.col("__scored").isNull()).alias("num_skipped"))


METHODS = Registry()
for _method in (
    ScoreMethod("loss_zlib_lowercase", "stats_of_texts", columns(loss_score=lambda: A.mean(_lp()), zlib_score=lambda: F.try_divide(A.total(_lp()), F.col("bytes").cast("double")), lowercase_score=lambda: A.mean(_lp()) - A.mean(F.col("low_lp")))),
    ScoreMethod("minkprob", "stats", _mink),
    ScoreMethod("dcpdd", "calibrated", columns(dc_pdd_score=lambda: F.col("dcpdd"))),
    ScoreMethod("recall", "likelihoods", lambda table: prefix_scores(table).withColumnRenamed("recall", "recall_score")),
    ScoreMethod("camia", "plain_p_values", _camia_plain),
    ScoreMethod("camia_faithful", "p_values", _camia),
    ScoreMethod("camia_lr", "classified", columns(camia_lr_score=lambda: F.col("p"))),
    ScoreMethod("pac", "contrasts", columns(pac_score=lambda: F.col("mean") - F.col("own"))),
    ScoreMethod("neighborhood_attack", "neighbours", _neighbours),
    ScoreMethod("dcq", "quiz", _quiz),
    ScoreMethod("cdd", "completions", _peaks),
    ScoreMethod("guided_instruction", "guided", _guided),
    ScoreMethod("selfcrit", "entropies", columns(self_critique_score=lambda: F.when((F.size("first") > 0) & (F.size("second") > 0), A.penalised_cosine(F.col("first"), F.col("second"))))),
    ScoreMethod("fsd", "before_and_after", columns(**{f"fsd_{m}_score": (lambda m=m: F.col(f"fsd_{m}_score")) for m in TUNED})),
    ScoreMethod("mia_tuner", "soft_prompt", columns(mia_tuner_score=lambda: F.col("p_yes"))),
):
    METHODS.add(_method)

#: Other names of methods.
METHODS.aliases = {
    "camia-faithful": "camia_faithful", "camia_code": "camia_faithful", "camia_official": "camia_faithful", "camia-lr": "camia_lr", "camia_appendix": "camia_lr", "camia_supervised": "camia_lr",
    "lowercase": "loss_zlib_lowercase", "perplexity": "loss_zlib_lowercase", "zlib": "loss_zlib_lowercase", "minkpp": "minkprob", "mia-tuner": "mia_tuner", "miatuner": "mia_tuner",
}

#: Names of scores in reports, and the method and column each stands for.
SCORES = {
    "ppl": ("loss_zlib_lowercase", "loss_score"), "zlib": ("loss_zlib_lowercase", "zlib_score"), "lowercase": ("loss_zlib_lowercase", "lowercase_score"),
    "mink": ("minkprob", "min_k_prob_mean_logprob"), "minkpp": ("minkprob", "min_k_pp_score"), "dcpdd": ("dcpdd", "dc_pdd_score"), "recall": ("recall", "recall_score"),
    "camia": ("camia", "camia_score"), "camia_lr": ("camia_lr", "camia_lr_score"), "camia_faithful": ("camia_faithful", "camia_faithful_score"), "pac": ("pac", "pac_score"),
    "neighborhood": ("neighborhood_attack", "score"), "dcq": ("dcq", "score"), "cdd": ("cdd", "peak"), "guided": ("guided_instruction", "score"), "selfcrit": ("selfcrit", "self_critique_score"),
    "fsd_ppl": ("fsd", "fsd_loss_score"), "fsd_zlib": ("fsd", "fsd_zlib_score"), "fsd_lower": ("fsd", "fsd_lowercase_score"), "fsd_mink": ("fsd", "fsd_mink_score"), "fsd_minkpp": ("fsd", "fsd_minkpp_score"),
    "base_ppl": ("fsd", "base_loss"), "base_zlib": ("fsd", "base_zlib"), "base_lower": ("fsd", "base_lowercase"), "base_mink": ("fsd", "base_mink"), "base_minkpp": ("fsd", "base_minkpp"),
    "mia_tuner": ("mia_tuner", "mia_tuner_score"),
}
#: Other names of those.
SCORE_ALIASES = {
    "perplexity": "ppl", "lower": "lowercase", "min-k": "mink", "min_k": "mink", "minkprob": "mink", "min-k++": "minkpp", "minkpp_": "minkpp", "dc-pdd": "dcpdd",
    "neigh": "neighborhood", "guided_instruction": "guided", "self-critique": "selfcrit", "self_critique": "selfcrit",
}


def score_column(name: str) -> tuple[str, str]:
    """Method and column of a score's name or alias; an unknown name raises."""
    return SCORES[SCORE_ALIASES.get(name.strip().lower(), name.strip().lower())]


# --- parameters --------------------------------------------------------------------------------------------------------

#: Parameters by model size; a size that is not there gets those under "".
TUNING = {
    "minkprob": {"": {"k": 0.2}},
    "dcpdd": {"1b": {"alpha": 0.001}, "7b": {"alpha": 0.2}, "13b": {"alpha": 0.05}, "32b": {"alpha": 0.2}, "": {"alpha": 0.01}},
    "recall": {"1b": {"n": 10}, "7b": {"n": 3}, "13b": {"n": 7}, "32b": {"n": 12}, "": {"n": 5}},
    "cdd": {"1b": {"alpha": 0.025, "length_cap": 50, "prompt_ratio": 0.5}, "7b": {"alpha": 0.075, "length_cap": 50, "prompt_ratio": 0.5}, "13b": {"alpha": 0.15, "length_cap": 50, "prompt_ratio": 0.25}, "32b": {"alpha": 0.3, "length_cap": 50, "prompt_ratio": 0.25}, "": {"alpha": 0.05, "length_cap": 100, "prompt_ratio": 0.5}},
    "dcq": {"1b": {"score_type": "min_pcorrect"}, "7b": {"score_type": "min_pcorrect"}, "13b": {"score_type": "pcorrect_kappa_np"}, "32b": {"score_type": "pcorrect_kappa"}, "": {"score_type": "mean_pcorrect"}},
    "guided_instruction": {"32b": {"score_type": "rouge_guided"}, "": {"score_type": "rouge_delta"}},
    "neighborhood_attack": {"": {"score_type": "d"}},
}


def parameters(method: str, size: str) -> dict:
    """Parameters of a method for a model size (1b, 7b, ...)."""
    table = TUNING.get(METHODS.normal(method), {"": {}})
    return table.get(size.strip().lower(), table.get("", {}))


def parameter_table(spark, method: str, sizes: Sequence[str]) -> DataFrame:
    """size and a column for each parameter, to be joined to scores."""
    rows = [{"size": s, **parameters(method, s)} for s in sizes]
    return spark.createDataFrame(pd.DataFrame(rows))


#: Grids that are searched on development data.
GRIDS = {
    "minkprob": {"k": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)},
    "dcpdd": {"alpha": (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5)},
    "recall": {"n": tuple(range(1, 13))},
    "camia": {"composition": ("edgington", "fisher", "george")},
    "cdd": {"alpha": (0.0, 0.01, 0.025, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3), "length_cap": (50, 100, 200), "prompt_ratio": (0.25, 0.5, 0.75)},
    "dcq": {"score_type": ("mean_pcorrect", "min_pcorrect", "pcorrect_kappa", "pcorrect_kappa_np")},
    "guided_instruction": {"score_type": ("rouge_guided", "rouge_general", "rouge_delta", "gpt4_icl")},
    "neighborhood_attack": {"score_type": ("d", "z")},
    "pac": {"far": (0.05, 0.10, 0.20), "near": (0.10, 0.20, 0.30, 0.40)},
}


def cells_of(settings: Sequence[str], values: Column) -> Column:
    """An array of cells (setting, score) from an array of scores."""
    return F.zip_with(F.array(*map(F.lit, settings)), values, lambda s, v: F.struct(s.alias("setting"), v.alias("score")))


def grid_cells(method: str, scores: Sequence[str] = ("mink", "minkpp")) -> Column:
    """The cells of a grid that are projections of a row of what the method reads, so that several methods can be swept in one pass over a table with the columns of all."""
    grid = GRIDS[method]
    if method == "minkprob":
        values = {"mink": _lp(), "minkpp": A.standardised(_lp(), F.col("mu"), F.col("sigma"))}
        return F.concat(*[cells_of([f"{s}={k:g}" for k in grid["k"]], V.bottom_means(values[s], grid["k"])) for s in scores])
    if method == "pac":
        return cells_of([f"far={a:g},near={b:g}" for a in grid["far"] for b in grid["near"]], V.polarised_gaps(F.col("own"), F.col("copies"), grid["far"], grid["near"]))
    if method == "neighborhood_attack":
        return cells_of("dz", F.array(*A.neighbour_scores(F.col("target"), F.col("others"))))
    raise ValueError(f"the grid of {method} is no projection")


def swept(method: str, table: DataFrame, scores: Sequence[str] = ("mink", "minkpp")) -> DataFrame:
    """id, setting, score of the method's grid over a table of what it reads, in one pass where a cell is a projection.

    minkprob: stats (settings like ``mink=0.2``; of its two ``scores`` those asked for, each text sorted once); pac: id, own, copies (arrays of log-probabilities, the copies'
    as an array of arrays); cdd: completions; dcq: quiz; guided_instruction: guided; neighborhood_attack: neighbours;
    dcpdd: calibrated (id, ceiling, dcpdd); camia: p_values; recall: id, n, conditional, plain.
    """
    grid = GRIDS[method]
    cell = lambda name, value: F.struct(F.lit(name).alias("setting"), value.cast("double").alias("score"))
    if method in ("minkprob", "pac", "neighborhood_attack"):
        return table.select("id", F.explode(grid_cells(method, scores)).alias("c")).select("id", "c.*")
    if method == "cdd":
        peaks = completion_peaks(table, [(a, c) for a in grid["alpha"] for c in grid["length_cap"]])
        return peaks.select("id", F.concat(F.lit("alpha="), F.format_string("%s", F.col("alpha")), F.lit(",cap="), F.col("cap").cast("string")).alias("setting"), F.col("peak").alias("score"))
    elif method == "dcpdd":
        return table.select("id", F.concat(F.lit("alpha="), F.col("ceiling").cast("string")).alias("setting"), F.col("dcpdd").alias("score"))
    elif method == "recall":
        return table.select("id", F.concat(F.lit("n="), F.col("n").cast("string")).alias("setting"), A.prefix_ratio(F.col("conditional"), F.col("plain")).alias("score"))
    else:
        wide = {"dcq": quiz_scores, "guided_instruction": guided_scores, "camia": S.combine}[method](table)
        (names,) = grid.values()
        table, cells = wide, [cell(n, F.col(n)) for n in names]
    return table.select("id", F.explode(F.array(*cells)).alias("c")).select("id", "c.*")
