"""Rule pass over the table of subscriptions (one JSON parameter text per row).

JSON is read as VARIANT, so scalar, list and object forms of one parameter are
told apart by type instead of by trial parsing.  Every rule is a column that is
``NULL`` for a valid row and a reason otherwise; the first failing rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.arrays import let
from trendloom.functions.text import is_blank, strip

# What the sources accept.
SOURCES = ("rss", "hackernews", "github")
URL_SCHEMES = ("http", "https")
STORY_ENDPOINTS = ("topstories", "newstories", "beststories", "askstories", "showstories", "jobstories")
STORY_LIMIT_MAX = 500
MAX_PARAMETERS = 50
URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)"


def _first(problems: Column) -> Column:
    return F.get(F.filter(problems, lambda p: p.isNotNull()), F.lit(0))


def _at(name: str, index: Column, what: str) -> Column:
    return F.concat(F.lit(name + "["), index.cast("string"), F.lit("] " + what))


def url_problem(url: Column, index: Column, name: str = "feed_urls") -> Column:
    """Why one url is refused: blank, without scheme or host, other scheme."""
    u = strip(url)
    scheme, host = F.regexp_extract(u, URL_PARTS, 1), F.regexp_extract(u, URL_PARTS, 2)
    return (
        F.when(is_blank(url), _at(name, index, "is blank"))
        .when((scheme == "") | (host == ""), _at(name, index, "is not a url"))
        .when(~F.lower(scheme).isin(*URL_SCHEMES), _at(name, index, "must use http or https"))
    )


def validate_urls(rows: DataFrame, urls: str) -> DataFrame:
    """Adds ``reason``: the first refused url of an array column, or ``NULL``."""
    problems = F.transform(F.coalesce(F.col(urls), F.array().cast("array<string>")), lambda u, i: url_problem(u, i))
    empty = F.when(F.coalesce(F.size(urls), F.lit(0)) <= 0, F.lit("feed_urls is missing"))
    return rows.withColumn("reason", F.coalesce(empty, _first(problems)))


class Parameters:
    """Typed access to one JSON parameter object in column ``source_params``."""

    def __init__(self, column: str = "source_params"):
        self.raw = F.coalesce(F.col(column), F.lit("{}"))
        self.variant = F.try_parse_json(self.raw)

    def kind(self, name: str) -> Column:
        """``STRING``, ``ARRAY``, ``OBJECT``, ``BIGINT``, ...; ``NULL`` when absent or null."""
        shape = F.schema_of_variant(F.try_variant_get(self.variant, f"$.{name}", "variant"))
        word = F.regexp_extract(shape, r"^[A-Z]+", 0)
        return F.when(word != "VOID", word)

    def text(self, name: str) -> Column:
        return F.try_variant_get(self.variant, f"$.{name}", "string")

    def items(self, name: str) -> Column:
        return F.try_variant_get(self.variant, f"$.{name}", "array<variant>")

    def texts(self, name: str) -> Column:
        """Scalar or list as an array of texts; members that are no text become ``NULL``."""
        members = F.transform(self.items(name), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
        kind = self.kind(name)
        return F.when(kind == "STRING", F.array(self.text(name))).when(kind == "ARRAY", members)

    def filled(self, name: str) -> Column:
        """True unless the value is absent, null, empty, zero or false."""
        kind, text = self.kind(name), self.text(name)
        zero = F.coalesce(F.expr("try_cast(0 AS DOUBLE)") == F.try_variant_get(self.variant, f"$.{name}", "double"), F.lit(False))
        return (
            F.when(kind.isNull(), F.lit(False))
            .when(kind == "STRING", text != "")
            .when(kind == "ARRAY", F.size(self.items(name)) > 0)
            .when(kind == "OBJECT", F.lit(True))
            .otherwise(~zero)
        )


def _rss_problem(p: Parameters) -> Column:
    kind, name = p.kind("feed_urls"), "feed_urls"

    def member(u: Column, i: Column) -> Column:
        return F.when(u.isNull(), _at(name, i, "is not text")).otherwise(url_problem(u, i))

    return (
        F.when(kind.isNull() | ((kind == "ARRAY") & ~p.filled(name)), F.lit("feed_urls is missing"))
        .when(~kind.isin("STRING", "ARRAY"), F.lit("feed_urls must be text or a list"))
        .otherwise(_first(F.transform(p.texts(name), member)))
    )


def _story_problem(p: Parameters) -> Column:
    many = p.filled("endpoints")
    kind = F.when(many, p.kind("endpoints")).otherwise(p.kind("endpoint"))
    values = F.when(many, p.texts("endpoints")).otherwise(p.texts("endpoint"))

    def member(e: Column, i: Column) -> Column:
        return F.when(is_blank(e), _at("endpoints", i, "is blank")).when(
            ~F.lower(strip(e)).isin(*STORY_ENDPOINTS), _at("endpoints", i, "is not allowed")
        )

    endpoints = F.when(kind.isNotNull() & ~kind.isin("STRING", "ARRAY"), F.lit("endpoints must be text or a list")).otherwise(
        _first(F.transform(values, member))
    )
    return F.coalesce(endpoints, _limit_problem(p))


def story_limit(p: Parameters) -> Column:
    """The limit as a number; ``NULL`` when absent or not a number."""
    own = p.filled("limit_per_endpoint")

    def number(name: str) -> Column:
        whole = F.when(strip(p.text(name)).rlike(r"^[+-]?\d+$"), strip(p.text(name)).try_cast("bigint"))
        return F.when(p.kind(name) == "STRING", whole).otherwise(
            F.try_variant_get(p.variant, f"$.{name}", "double").try_cast("bigint")
        )

    return F.when(own, number("limit_per_endpoint")).otherwise(number("limit"))


def _limit_problem(p: Parameters) -> Column:
    given = p.filled("limit_per_endpoint") | p.kind("limit").isNotNull()
    return let(
        story_limit(p),
        lambda n: F.when(given & n.isNull(), F.lit("limit must be an integer")).when(
            given & ~n.between(1, STORY_LIMIT_MAX), F.lit("limit must be 1..500")
        ),
    )


REPOSITORY = "array<struct<owner:string,repo:string>>"


def repositories(p: Parameters) -> Column:
    """Object, list or flat pair as an array of trimmed (owner, repo)."""
    listed = F.try_variant_get(p.variant, "$.repos", REPOSITORY)
    one = F.array(F.try_variant_get(p.variant, "$.repos", "struct<owner:string,repo:string>"))
    flat = F.array(F.struct(p.text("owner").alias("owner"), p.text("repo").alias("repo")))
    kind = p.kind("repos")
    picked = F.when(kind.isNull(), flat).when(kind == "OBJECT", one).when(kind == "ARRAY", listed)
    return F.transform(
        picked, lambda r: F.struct(strip(F.coalesce(r["owner"], F.lit(""))).alias("owner"), strip(F.coalesce(r["repo"], F.lit(""))).alias("repo"))
    )


def _repository_problem(p: Parameters) -> Column:
    kind = p.kind("repos")

    def member(r: Column, i: Column) -> Column:
        incomplete = (r["owner"] == "") | (r["repo"] == "")
        flat = F.lit("owner and repo are required")
        return F.when(incomplete, F.when(kind.isNull(), flat).otherwise(_at("repos", i, "needs owner and repo")))

    members = F.transform(p.items("repos"), lambda v: ~F.schema_of_variant(v).startswith("OBJECT"))
    return (
        F.when(kind.isNotNull() & ~kind.isin("OBJECT", "ARRAY"), F.lit("repos must be a list or an object"))
        .when((kind == "ARRAY") & (F.size(p.items("repos")) == 0), F.lit("repos is empty"))
        .when((kind == "ARRAY") & F.exists(members, lambda b: b), F.lit("repos members must be objects"))
        .otherwise(_first(F.transform(repositories(p), member)))
    )


def validate_subscriptions(rows: DataFrame) -> DataFrame:
    """Adds ``reason`` (``NULL`` when valid) to ``(user_id, source, source_params)``."""
    p = Parameters()
    too_many = F.coalesce(F.size(F.json_object_keys(p.raw)), F.lit(0)) > MAX_PARAMETERS
    by_source = (
        F.when(F.col("source") == "rss", _rss_problem(p))
        .when(F.col("source") == "hackernews", _story_problem(p))
        .otherwise(_repository_problem(p))
    )
    unknown = ~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))
    broken = p.variant.isNull() | (F.regexp_extract(F.schema_of_variant(p.variant), r"^[A-Z]+", 0) != "OBJECT")
    return rows.withColumn(
        "reason",
        F.when(unknown, F.lit("source is not supported"))
        .when(broken, F.lit("parameters are not an object"))
        .when(too_many, F.lit("too many parameters"))
        .otherwise(by_source),
    )


def validate_allowed_and_range(rows: DataFrame) -> DataFrame:
    """The story rule alone: endpoints from the allowed set, limit 1..500."""
    return rows.withColumn("reason", _story_problem(Parameters()))


def expand_scalar_or_list(rows: DataFrame) -> DataFrame:
    """One row per (owner, repo); a refused row gives one row with its reason."""
    p = Parameters()
    reasoned = rows.withColumn("reason", _repository_problem(p))
    nothing = F.array().cast("array<struct<owner:string,repo:string>>")
    targets = F.when(F.col("reason").isNull(), repositories(p)).otherwise(nothing)
    kept = reasoned.select(*rows.columns, "reason", F.posexplode_outer(targets).alias("position", "target"))
    return kept.select(*rows.columns, "reason", "position", "target.owner", "target.repo")


def requests(rows: DataFrame, default_limit: int = 50, keep: Sequence[str] = ()) -> DataFrame:
    """Valid subscriptions as one row per (user, source, target) with defaults filled in, and the columns to ``keep``.

    Feeds: one row per url.  Stories: the endpoints, ``topstories`` when none is
    named; ``limit_per_endpoint`` goes before ``limit``.  Repositories: one row
    per repository, all item types included and all states unless set.
    """
    p = Parameters()
    valid = validate_subscriptions(rows).where("reason IS NULL")
    many = p.filled("endpoints")
    endpoints = F.coalesce(F.when(many, p.texts("endpoints")).otherwise(p.texts("endpoint")), F.array(F.lit("topstories")))
    names = F.transform(repositories(p), lambda r: F.concat(r["owner"], F.lit("/"), r["repo"]))
    targets = F.when(F.col("source") == "rss", F.transform(p.texts("feed_urls"), strip)).when(
        F.col("source") == "hackernews", F.transform(endpoints, lambda e: F.lower(strip(e)))
    ).otherwise(names)
    number = F.when(F.col("source") == "hackernews", story_limit(p)).when(
        F.col("source") == "github", F.try_variant_get(p.variant, "$.limit_per_type", "bigint")
    ).otherwise(F.try_variant_get(p.variant, "$.limit", "bigint"))

    def flag(name: str) -> Column:
        return F.coalesce(F.try_variant_get(p.variant, f"$.include_{name}", "boolean"), F.lit(True)).alias(f"include_{name}")

    return valid.select(
        "user_id", "source", *keep, F.explode(targets).alias("target"), F.coalesce(number, F.lit(default_limit)).alias("item_limit"),
        *[flag(n) for n in ("commits", "issues", "prs", "releases")],
        F.coalesce(p.text("issue_state"), F.lit("all")).alias("issue_state"),
        F.coalesce(p.text("pr_state"), F.lit("all")).alias("pr_state"), p.text("commit_since").alias("commit_since"),
    )
