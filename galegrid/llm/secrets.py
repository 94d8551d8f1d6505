"""Secret scans: candidates by pattern, false positives removed by a random forest trained from labelled findings."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, text_of
from .spans import document_frequency, match_spans

#: A run of 16 characters or more of which one is a digit; the scan starts only where a run does.
CANDIDATE = r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{16,}+"
LETTERS = r"[a-z]{3,}"
WINDOW = 40
#: Words that name a secret when they stand before it, and formats that credentials are issued in.
NAMING = ["token", "key", "secret", "password", "passwd", "auth", "bearer", "apikey", "credential", "passphrase", "pwd"]
FORMATS = [
    r"^(?:AKIA|ASIA)[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{30,}$", r"^github_pat_[A-Za-z0-9_]{30,}$", r"^glpat-[A-Za-z0-9_-]{16,}$",
    r"^xox[abeoprs]-[A-Za-z0-9-]{10,}$", r"^sk-[A-Za-z0-9_-]{20,}$", r"^[rs]k_(?:live|test)_[A-Za-z0-9]{16,}$", r"^AIza[A-Za-z0-9_-]{35}$",
    r"^npm_[A-Za-z0-9]{30,}$", r"^eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+)*$",
]
#: What stands between a naming word and its value; a value of letters and digits; the line before a private key's body.
GIVEN = r"[A-Za-z0-9_-]{0,20}[\"']?\s{0,4}(?:=>|[=:]{1,2})\s{0,4}[\"']?"
MIXED = r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_/+=.-]{16,}"
KEY_HEAD = r"PRIVATE KEY-----\s*$"
#: Shapes known to be harmless: digits (cards, dates, phones), order numbers and the like, paths of lower-case names.
HARMLESS = [r"^[0-9_/+=-]+$", r"(?i)^(?:order|invoice|item|sku|ref|case|ticket|page|isbn)[_=-]*[0-9][0-9_=-]*$", r"^/?(?:[a-z]{2,}(?:[_-][a-z]{2,})*[0-9]{0,4}/){2,}[a-z0-9_-]*$"]
#: Values given to a naming word or after "bearer", 6 signs or more: to the closing quote (blanks are let in), else to the next
#: blank without the closing marks before it; and dotted tokens (JWT). The cheap conditions stand first.
SPOT = rf"(?<=[=:>\s\"'])(?:(?<=[=:>]\s{{0,4}}[\"']?)(?<=(?i:{'|'.join(NAMING)}|pass){GIVEN})|(?<=(?i:bearer)\s{{1,4}}))(?![\"'\s=:>])"
VALUE = (
    rf"{SPOT}(?:(?<=\")[^\"\n]{{6,}}+(?=\")|(?<=')[^'\n]{{6,}}+(?=')|[^\s]{{5,}}[^\s\"'`,;.)\]}}>])"
    r"|(?<![A-Za-z0-9_/+=.-])eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)++"
)
#: Paths of files that hold settings or code, and of those whose values are made up.
CODE_PATH = r"\.(?:py|js|ts|java|go|rb|php|cs|sh|c|h|cpp|rs|sql|json|ya?ml|toml|ini|cfg|conf|env|properties|xml|tf|log)$|(?:^|/)\.env|config"
TEST_PATH = r"(?:^|[/_.-])(?:tests?|specs?|examples?|samples?|docs?|fixtures?|mocks?|demos?)(?:[/_.-]|$)"
FEATURES = ["length", "digits", "upper", "lower", "changes", "distinct", "hex", "known", "slashes", "path_depth", "path_code", "path_test", "named", "assigned", "quoted", "words_before"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, start, end, found, before, after, source) of each candidate. source: of the row that the candidate is in
    (rows with the same doc_id and text: the smallest).

    Runs by CANDIDATE, and values by VALUE, which may be short, without digits, or hold any signs. A run inside a value (or
    equal to it) is that value's; a run that goes beyond a value is a candidate beside it. Out of scope: values under 6 signs,
    runs under 16 or without a digit that no naming word is given, and what stands in markup between tags.
    """
    both = match_spans(docs, {"run": CANDIDATE, "value": VALUE}, WINDOW)
    # values don't overlap, so the one that started last before a run is the only one that it can be in
    last = F.max(F.when(F.col("kind") == "value", F.col("end"))).over(Window.partitionBy("doc_id", "rid").orderBy("start"))
    alone = both.withColumn("last", last).where((F.col("kind") == "value") | F.col("last").isNull() | (F.col("end") > F.col("last"))).drop("last", "kind")
    # a run and a value that start together are told apart by their ends: the longer has all of the other
    found = alone.groupBy("doc_id", "rid", "start").agg(F.max_by(F.struct("end", "found", "before", "after"), "end").alias("x")).select("doc_id", "rid", "start", "x.*")
    if "source" not in docs.columns:
        return found.withColumn("source", F.lit(None).cast("string"))
    sources = docs.select(F.col("doc_id").alias("s_doc"), F.xxhash64(text_of()).alias("s_rid"), F.col("source").cast("string").alias("source"))
    named = found.join(sources, found.doc_id.eqNullSafe(F.col("s_doc")) & (found.rid == F.col("s_rid")))
    return named.groupBy(*found.columns).agg(F.min("source").alias("source"))


def with_features(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found with FEATURES. known is the dictionary coverage: the share of the candidate in runs of letters that are words of
    five documents or more, counted over all documents; path_... are of source, the path of the document."""
    text, n = F.col("found"), F.char_length("found")
    runs = F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))
    terms = kept(found.select(F.explode(runs).alias("term")).distinct())
    words = document_frequency(docs, terms, r"(?<![\p{L}\p{N}])[a-z]{3,}(?![\p{L}\p{N}])").where("df >= 5")
    key = ["doc_id", "rid", "start"]
    cover = found.select(*key, F.explode(runs).alias("term")).join(words, "term").groupBy(*key).agg(F.sum(F.char_length("term")).alias("covered"))
    cover = cover.withColumnsRenamed({k: f"c_{k}" for k in key})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in key])

    def share(pattern: str):
        return F.regexp_count(text, F.lit(pattern)) / n

    before, path = F.lower("before"), F.lower(F.coalesce("source", F.lit("")))
    naming = "(" + "|".join(NAMING) + ")"
    return found.join(cover, match, "left").withColumns({
        "length": n.cast("double"), "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"),
        "changes": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Za-z0-9])[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(text, ""))) / n, "hex": share("[0-9a-f]"),
        "known": F.coalesce(F.col("covered") / n, F.lit(0.0)), "slashes": share("/"),
        "path_depth": F.regexp_count(path, F.lit("/")).cast("double"), "path_code": path.rlike(CODE_PATH).cast("double"), "path_test": path.rlike(TEST_PATH).cast("double"),
        "named": (before.rlike(naming) | F.lower(text).rlike("^" + naming)).cast("double"),
        "assigned": (F.col("before").rlike(r"[=:]\s*[\"']?$") | text.rlike("[A-Za-z]=[^=]")).cast("double"),
        "quoted": F.col("before").rlike("[\"']$").cast("double"),
        "words_before": F.least(F.lit(10), F.regexp_count("before", F.lit(r"[\p{L}]{2,}"))).cast("double"),
    }).drop("covered", *[f"c_{k}" for k in key])


def any_of(column: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [column.rlike(p) for p in patterns])


def labelled_findings(found: DataFrame) -> DataFrame:
    """(doc_id, rid, start, is_secret) of every candidate; a stand-in for reviewed findings that labels only what is known.

    1: formats that credentials are issued in, values of letters and digits (16 or more) right after a naming word and = or :,
    first lines of private keys. 0: shapes known to be harmless that no naming word is given to; dictionary words (where found
    has known) that aren't given to a password. Null: all others.
    """
    text, before = F.col("found"), F.col("before")
    naming = "(?:" + "|".join(NAMING) + ")"
    given = before.rlike(f"(?i){naming}{GIVEN}$")
    secret = any_of(text, FORMATS) | (given & text.rlike(f"^{MIXED}$")) | text.rlike(f"^(?i:[a-z_-]*{naming}[a-z0-9_-]{{0,20}}=){MIXED}$") | before.rlike(KEY_HEAD)
    harmless = ~given & any_of(text, HARMLESS)
    if "known" in found.columns:
        to_password = before.rlike(f"(?i)(?:pass|pwd){GIVEN}$")
        harmless |= ~to_password & text.rlike("^[A-Za-z_/+=-]+[0-9]{0,2}$") & (F.col("known") >= 0.8)
    label = F.when(secret, 1.0).when(harmless, 0.0)
    return found.select("doc_id", "rid", "start", label.alias("is_secret"))


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, train_rows: int = 20_000, trees: int = 40, threshold: float = 0.5) -> DataFrame:
    """Candidates with the forest's verdict: (doc_id, rid, start, end, found, score, is_secret, labelled); positions count code points. labelled: a finding, or
    without findings a rule, says what the candidate is, so the forest only repeats it; the others the forest decides.

    findings: (doc_id, rid, start, is_secret) of reviewed candidates; None: labelled_findings. Candidates without a label are
    scored, but nothing is learnt from them. The forest is trained on train_rows of them at most, those of smallest hash, half
    of each kind (more where the other kind has fewer), and both kinds weigh the same; it scores every candidate. If the whole
    table of findings is of one kind, every score is that kind's; without findings, 0.5 and not secret. Null texts: no
    candidates. Long texts are searched whole. Null doc_id: kept. Equal rows: their candidates are given once. Empty table: no rows. Extra columns are left out.
    """
    found = kept(candidates(docs))
    table = kept(with_features(docs, found))
    labels = (findings if findings is not None else labelled_findings(table)).select(
        F.col("doc_id").alias("l_doc"), F.col("rid").alias("l_rid"), F.col("start").alias("l_start"), F.col("is_secret").cast("double").alias("label")
    )
    match = F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("rid") == F.col("l_rid")) & (F.col("start") == F.col("l_start"))
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    joined = kept(
        table.join(labels.where("label is not null").withColumn("label", (F.col("label") > 0.5).cast("double")), match)
        .select("label", *FEATURES, F.xxhash64("doc_id", "rid", "start").alias("h"))
    )
    counts = {r["label"]: r["count"] for r in joined.groupBy("label").count().collect()}
    told = labels.where("label is not null").select("l_doc", "l_rid", "l_start").distinct()
    data = data.join(told, match, "left")
    columns, labelled = ["doc_id", "rid", "start", "end", "found"], F.col("l_rid").isNotNull().alias("labelled")
    if len(counts) < 2:
        score = F.lit(next(iter(counts), 0.5))
        return data.select(*columns, score.alias("score"), (score > threshold).alias("is_secret"), labelled)
    # what one kind leaves of its half, the other may use
    sizes = {k: min(n, max(1, train_rows // 2, train_rows - counts[1.0 - k])) for k, n in counts.items()}
    chosen = kept(reduce(DataFrame.unionByName, [joined.where(F.col("label") == k).orderBy("h").limit(n) for k, n in sizes.items()]))
    weight = F.when(F.col("label") > 0, F.lit(sum(sizes.values()) / (2 * sizes[1.0]))).otherwise(sum(sizes.values()) / (2 * sizes[0.0]))
    train = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(chosen.withColumn("weight", weight))
    model = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=8, seed=5).fit(train)
    scored = model.transform(data).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select(*columns, "score", (F.col("score") > threshold).alias("is_secret"), labelled)
