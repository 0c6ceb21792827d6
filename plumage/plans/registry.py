"""Steps as rows (place, id, needs, produces): what they need and produce, their depth, and rules on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumage.functions.text import nonblank
from plumage.operators.lineage import cut


def edges(steps: DataFrame) -> DataFrame:
    """(before, after) of steps: the producer of what the other needs. Of several producers the last counts; what none produces is ignored."""
    makers = steps.select("place", "id", F.explode("produces").alias("a")).groupBy("a").agg(F.max_by("id", "place").alias("before"))
    return steps.select(F.col("id").alias("after"), F.explode("needs").alias("a")).join(makers, "a").select("before", "after").distinct()


def depths(steps: DataFrame) -> DataFrame:
    """(id, depth): the length of the longest chain of producers before each step. Steps that need each other are an error.

    Each round moves every step behind its producers; a chain is at most as long as the list of steps.
    """
    if steps.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("a step is listed twice")
    links, now = edges(steps), steps.select("id", F.lit(0).alias("depth"))
    for _ in range(steps.count() + 1):
        behind = links.join(now.withColumnRenamed("id", "before"), "before").groupBy(F.col("after").alias("id")).agg((F.max("depth") + 1).alias("least"))
        moved = cut(now.join(behind, "id", "left").select("id", F.greatest("depth", F.coalesce("least", F.lit(0))).alias("depth"), (F.col("least") > F.col("depth")).alias("moved")))
        now = moved.select("id", "depth")
        if not moved.where("moved").limit(1).count():
            return now
    raise ValueError("steps need each other")


def providers(steps: DataFrame, artifact: str) -> DataFrame:
    return steps.where(F.array_contains("produces", artifact))


def readiness(pages: DataFrame) -> DataFrame:
    """By page, from (page, kind, done): whether there is any node, and whether all are done (so for a page without nodes)."""
    return pages.groupBy("page").agg(F.coalesce(F.bool_or(F.col("kind").isNotNull()), F.lit(False)).alias("any"), F.coalesce(F.bool_and("done"), F.lit(True)).alias("all"))


# What each artifact of a page asks for: a node of a kind and role, or something of every text node.
BY_ROLE = {"SourceImage": ("image", "source"), "Inpainted": ("image", "inpainted"), "SegmentMask": ("mask", "segment"), "BubbleMask": ("mask", "bubble"), "BrushMask": ("mask", "brush"), "FinalRender": ("image", "rendered")}
OF_TEXTS = ("OcrText", "FontPredictions", "Translations", "RenderedSprites")


def artifacts(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page, artifact, ready) for every page and artifact.

    nodes: (page, kind, role, text, translation, predicted, sprite), the last two being whether there is one. Artifacts of texts hold on
    a page without texts, too; a text that is blank needs no translation.
    """
    spoken = nonblank(F.col("text"))
    texts = {"OcrText": spoken, "FontPredictions": F.col("predicted"), "Translations": ~spoken | nonblank(F.col("translation")), "RenderedSprites": F.col("sprite")}
    is_text = F.col("kind") == "text"
    some = {"TextBoxes": is_text} | {k: (F.col("kind") == kind) & (F.col("role") == role) for k, (kind, role) in BY_ROLE.items()}
    found = nodes.groupBy("page").agg(
        *[F.coalesce(F.bool_or(x), F.lit(False)).alias(k) for k, x in some.items()],
        *[F.coalesce(F.bool_and(F.when(is_text, F.coalesce(texts[k], F.lit(False)))), F.lit(True)).alias(k) for k in OF_TEXTS],
    )
    every = pages.select("page").join(found, "page", "left")
    ready = [F.struct(F.lit(k).alias("artifact"), F.coalesce(k, F.lit(k in OF_TEXTS)).alias("ready")) for k in [*some, *OF_TEXTS]]
    return every.select("page", F.explode(F.array(*ready)).alias("a")).select("page", "a.artifact", "a.ready")


def catalogue(packages: DataFrame) -> DataFrame:
    """Packages (id, place, bootstrap, enabled) by place and id, numbered, with whether each is prepared at the start; an id that comes twice is an error.

    A catalogue is a fixed list of a program's parts, so its order is a window over all of it.
    """
    twice = F.count("*").over(Window.partitionBy("id")) > 1
    p = packages.withColumn("id", F.when(twice, F.raise_error(F.concat(F.lit("listed twice: "), F.col("id")))).otherwise(F.col("id")))
    return p.select("id", F.row_number().over(Window.orderBy("place", "id")).alias("position"), (F.col("bootstrap") & F.col("enabled")).alias("prepared"))


def validated(wanted: DataFrame, known: DataFrame, default: str) -> DataFrame:
    """Names that aren't known become the default."""
    k = known.select(F.col("id").alias("_k"))
    return wanted.join(k, wanted["name"] == k["_k"], "left").withColumn("name", F.coalesce("_k", F.lit(default))).drop("_k")
