"""Domain views of a paper's chunks: architectures by mention weight, candidates by text, snippets; canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as T


def first_with(text: Column, kinds: dict[str, list[str]], default: str) -> Column:
    """The first kind of which a text holds a word."""
    low, out = F.lower(text), None
    for kind, words in kinds.items():
        test = T.contains_any(low, words)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return F.coalesce(out.otherwise(default), F.lit(default))


def model_family(name: Column, architecture: Column) -> Column:
    return first_with(F.concat_ws(" ", name, architecture), L.MODEL_FAMILIES, "mlp")


def task_type(dataset: Column, objective: Column, architecture: Column) -> Column:
    return first_with(F.concat_ws(" ", dataset, objective, architecture), L.TASK_TYPES, "generic_supervised")


def loss_name(name: Column) -> Column:
    low, out = F.lower(F.trim(F.coalesce(F.nullif(name, F.lit("")), F.lit("cross_entropy")))), None
    for canonical, aliases in L.LOSS_ALIASES.items():
        test = low.isin([canonical, *aliases])
        out = F.when(test, canonical) if out is None else out.when(test, canonical)
    return out.when(F.contains(low, F.lit("ctc")), "ctc").when(F.contains(low, F.lit("bce")), "bce_with_logits").when(F.contains(low, F.lit("mse")), "mse").otherwise("cross_entropy")


def optimizer_name(name: Column) -> Column:
    return first_with(F.coalesce(name, F.lit("adam")), {"adamw": ["adamw"], "sgd": ["sgd"], "rmsprop": ["rmsprop"]}, "adam")


def identifier(name: Column) -> Column:
    """A class name of what stands before the first colon, stop, comma or semicolon."""
    head = F.split(F.trim(name), r"[:.,;]\s*", 2)[0]
    words = F.filter(F.split(F.regexp_replace(head, "[^0-9a-zA-Z]+", " "), " "), lambda w: w != "")
    made = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "")
    return F.when(made == "", "GeneratedModel").otherwise(made)


def architecture_name(name: Column) -> Column:
    s = F.trim(name)
    return F.coalesce(T.lookup(F.trim(F.replace(F.lower(s), F.lit(" model"), F.lit(""))), L.CANONICAL_ARCHITECTURES, None), s)


def distinct_architectures(names: Column) -> Column:
    """Canonical names in order, each once, case aside."""
    made = F.transform(names, architecture_name)
    lows = F.transform(made, lambda n: F.lower(n))
    return F.filter(F.transform(made, lambda n, i: F.when(F.array_position(lows, F.lower(n)) == i + 1, n)), lambda n: n.isNotNull())


def domain_name(domain: Column) -> Column:
    low = F.lower(F.coalesce(domain, F.lit("general")))
    return F.when(low.isin(L.PAPER_DOMAINS), low).otherwise("general")


def domain_label(domain: Column) -> Column:
    name = domain_name(domain)
    return F.when(name == "ml", "Machine Learning").otherwise(F.initcap(name))


def file_title(title: Column) -> Column:
    s = F.trim(title)
    return F.coalesce(s.isNull() | (s == "") | s.rlike(L.FILE_TITLE) | F.contains(s, F.lit("_")) | (F.size(F.split(T.squeeze(s), " ")) <= 1), F.lit(True))


def search_title(title: Column, text: Column, architecture: Column) -> Column:
    """A title to search by: the text's own where the given one is a file's name or shorter, else the given one, else the architecture."""
    found = T.title(text)
    better = found.isNotNull() & (file_title(title) | (F.length(found) > F.length(F.coalesce(title, F.lit("")))))
    return F.when(better, found).when(~file_title(title), title).otherwise(F.coalesce(F.nullif(architecture, F.lit("")), title))


def repository_slug(url: Column, host: str = r"github\.com") -> Column:
    """struct(owner, name) of a repository's address; null otherwise."""
    s, pattern = F.trim(url), rf"(?i)^https?://{host}/([^/]+)/([^/]+)/?$"
    return F.when(s.rlike(pattern), F.struct(F.regexp_extract(s, pattern, 1).alias("owner"), F.regexp_extract(s, pattern, 2).alias("name")))


def architectures(rows: DataFrame, key: str, aliases: dict[str, list[str]] = L.ARCHITECTURE_ALIASES, proposals: list[str] = L.PROPOSAL_PATTERNS, baselines: list[str] = L.BASELINE_PATTERNS, bonus: dict[str, float] = L.SPECIFICITY, suppressed: dict[str, list[str]] = L.SUPPRESSED_BY) -> DataFrame:
    """Per key of texts (content, role, section_name): the architectures it proposes (three at most), compares with (three) and
    names (five), by weighted mentions. Sums are per key and name, so that no list of texts is gathered."""
    low = F.lower("content")
    context = 1.0 + F.when(F.col("role").isin("idea", "method", "algorithm"), 0.35).otherwise(0.0) + F.when(F.lower("section_name").isin("abstract", "introduction", "method"), 0.25).otherwise(0.0)
    any_of = lambda ps: F.coalesce(low.rlike("|".join(f"(?:{p})" for p in ps)), F.lit(False))
    hits = F.filter(F.array(*[F.when(any_of(ps), F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(bonus.get(n, 0.0)).alias("bonus"))) for i, (n, ps) in enumerate(aliases.items())]), lambda h: h.isNotNull())
    items = rows.select(key, context.alias("boost"), any_of(proposals).alias("proposes"), any_of(baselines).alias("compares"), F.explode(hits).alias("h"))
    sums = items.groupBy(key, "h.i", "h.name").agg(
        F.sum(F.col("boost") + F.col("h.bonus")).alias("mentioned"), F.sum(F.when(F.col("proposes"), 1.6 + F.col("boost") + F.col("h.bonus")).otherwise(0.0)).alias("proposed"), F.sum(F.when(F.col("compares"), 1.2 + F.col("boost")).otherwise(0.0)).alias("baseline"),
    )
    sums = sums.withColumns({c: F.round(c, 6) for c in ("mentioned", "proposed", "baseline")})
    order = Window.partitionBy(key).orderBy(F.desc(F.round(F.col("proposed") * 2 + F.col("mentioned") - F.col("baseline"), 6)), F.desc("mentioned"), "i")
    ranked = sums.withColumn("place", F.row_number().over(order)).withColumn("offered", (F.col("proposed") > 0) & (F.col("proposed") >= F.col("baseline")))
    none = F.max(F.col("offered").cast("int")).over(Window.partitionBy(key)) == 0
    ranked = ranked.withColumn("offered", F.col("offered") | (none & (F.col("place") == 1)))
    listed = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "name", "offered", (F.col("baseline") > F.col("proposed")).alias("beaten")))).alias("all"))  # as many as there are names at most

    def drop(kept: Column, x: Column) -> Column:
        stop = F.lit(False)
        for by, names in suppressed.items():
            stop = stop | (F.array_contains(kept, by) & x["name"].isin(names))
        return F.when(x["offered"] & ~stop, F.array_append(kept, x["name"])).otherwise(kept)

    chosen = listed.withColumn("kept", F.aggregate("all", F.array().cast("array<string>"), drop))
    beaten = F.transform(F.filter("all", lambda x: x["beaten"] & ~F.array_contains(F.col("kept"), x["name"])), lambda x: x["name"])
    return chosen.select(key, F.slice("kept", 1, 3).alias("proposed"), F.slice(beaten, 1, 3).alias("baseline"), F.slice(F.transform("all", lambda x: x["name"]), 1, 5).alias("mentioned"))


def snippets(rows: DataFrame, key: str, order: str, kinds: dict[str, tuple[str, int]] = L.SNIPPETS) -> DataFrame:
    """(key, kind, snippets): the first different matches of each kind's pattern in a key's texts (content), in order."""

    def named(kind: str):
        return lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.trim(m).alias("m"))

    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("content", F.lit("(?i)" + p), F.lit(1)), named(k)) for k, (p, _) in kinds.items()]))
    parts = rows.select(key, F.col(order).alias("o"), F.explode(found).alias("f")).filter(F.col("f.m") != "")
    once = parts.groupBy(key, "f.kind", "f.m").agg(F.min(F.struct("o", "f.i")).alias("at"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy(key, "kind").orderBy("at", "m")))
    few = ranked.filter(F.col("r") <= T.lookup(F.col("kind"), {k: n for k, (_, n) in kinds.items()}, 8))
    return few.groupBy(key, "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "m"))), lambda x: x["m"]).alias("snippets"))


def names_view(rows: DataFrame, key: str, kinds: dict[str, list[str]]) -> DataFrame:
    """Per key, the names of each kind that any of its texts (content) holds, in the order of the list."""
    low = F.lower("content")
    seen = [F.max(F.contains(low, F.lit(n.lower())).cast("int")).alias(f"n_{k}_{i}") for k, names in kinds.items() for i, n in enumerate(names)]
    agg = rows.groupBy(key).agg(*seen)
    return agg.select(key, *[F.filter(F.array(*[F.when(F.col(f"n_{k}_{i}") == 1, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull()).alias(k) for k, names in kinds.items()])


def training_view(view: DataFrame) -> DataFrame:
    """A names_view (datasets, losses, optimizers) with the primary ones and the objective they make."""
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    parts = F.concat_ws(" ", F.concat(F.lit("Optimizes "), first("losses")), F.concat(F.lit("with "), first("optimizers")), F.concat(F.lit("on "), first("datasets")))
    return view.withColumns({"loss": first("losses"), "optimizer": first("optimizers"), "dataset": first("datasets"), "training_objective": F.nullif(parts, F.lit(""))})


# Values given as JSON, lists or text


def list_field(value: Column) -> Column:
    """A field that is to be a list: a JSON array's non-blank items as text, an object or other text as one item; null for none."""
    s = F.trim(value)
    parsed = F.try_parse_json(s)
    items = F.from_json(F.when(s.startswith("["), s), "array<string>")
    as_list = F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.when(s.isNull() | (s == "") | (s == "null"), F.lit(None)).when(s.startswith("[") & parsed.isNotNull(), as_list).otherwise(F.array(F.when(s.startswith('"') & parsed.isNotNull(), F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>")[0]).otherwise(value)))


def mapping(value: Column) -> Column:
    """A JSON object as a map of texts; null if it isn't one."""
    s = F.trim(value)
    return F.when(s.startswith("{") & F.try_parse_json(s).isNotNull(), F.from_json(s, "map<string,string>"))


def flattened(value: Column) -> Column:
    """The values of a flat JSON object, in order, parted by blanks."""
    return F.array_join(F.map_values(mapping(value)), " ")
