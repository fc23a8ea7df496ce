"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame and JVM functions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, packed, release, unpacked

#: Runs that may be secrets.
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
#: Where a run is parted: after the = of a name, if a candidate's length follows.
ASSIGNMENT = "(?<==)(?=[A-Za-z0-9+/_-][A-Za-z0-9+/_=-]{15})"
#: Code points kept from before and after a candidate.
BEFORE, AFTER = 48, 24
#: A bound for the labelled findings that a forest is fitted on; larger sets are cut to those of the smallest hash.
TRAINING_ROWS = 20_000
TREES, DEPTH, SEED = 24, 7, 7
THRESHOLD = 0.5

#: Words that stand before secrets, and before other runs of the same looks.
SECRET_WORDS = "token|secret|passw|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key"
OTHER_WORDS = "commit|sha1|sha256|sha512|md5|checksum|hash|digest|uuid|revision|etag|integrity|base64|image|version|build"
#: Words that make a run readable, longest first where one begins with another.
DICTIONARY = (
    "account address admin android another apache application archive array auth available backup based because before between boolean browser "
    "bucket build button cache change channel class client cloud cluster code color column command comment commit common component config connection "
    "console constant content context controller copy count create current custom database data date debug default delete deploy description dev device "
    "directory document domain download dummy element email enabled encoding endpoint engine entry environment error event example example exception "
    "factory false field file filter first folder format from function generate get global google group handler hash header hello here home host "
    "http image import index info input insert instance integer interface internal invalid item java json key language last latest length level "
    "library license limit line link list load local location logger login long main manager mapping master matrix message metadata method model module "
    "name network none number object office option order output package page parameter parse password path pattern person placeholder platform point "
    "policy port primary private process product production profile project property protocol provider public python query random read record reference "
    "region release remote replace report request resource response result return role root sample schema script search secret section security select "
    "server service session set setting share short simple site size source stack start state static status storage string style system table "
    "target task team template temp test text this time title token tool total tree true type unique unit update upload url user usr value variable "
    "version view virtual volume web website window with word workflow world write your"
).split()
#: Frequent pairs of letters in prose.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()


def _offsets(pieces: Column, found: Column) -> Column:
    """Where each found run starts: sums over all before it, in blocks, so that long texts do not cost the square."""
    block = 128
    lengths = F.transform(F.arrays_zip(pieces.alias("p"), found.alias("f")), lambda z: F.length(z["p"]) + F.coalesce(F.length(z["f"]), F.lit(0)))
    zero = F.lit(0)
    rows = F.transform(F.sequence(zero, F.floor((F.size(pieces) - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, block))
    grown = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    total = lambda r: F.aggregate(r, zero, lambda a, x: a + x)
    starts = F.aggregate(F.transform(rows, total), F.array(zero), grown)
    inner = F.zip_with(rows, starts, lambda r, s: F.when(r.isNotNull(), F.slice(F.aggregate(r, F.array(s), grown), 1, F.size(r))))
    return F.flatten(F.filter(inner, lambda x: x.isNotNull()))


def candidates(docs: DataFrame) -> DataFrame:
    """doc (the whole row), start, run, before, after, left, right of every candidate of every text; start counts code points from 0.

    before and after end at the neighbouring candidates; left and right are the text's own, with earlier and later runs.
    """
    rows = packed(docs).where(F.col("doc.text").rlike(CANDIDATE))
    text = F.col("doc.text")
    cut = rows.select("doc", F.split(text, CANDIDATE, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"))
    # a column for each step: a lambda evaluates what it refers to each time it is called
    cut = cut.withColumn("offsets", _offsets(F.col("pieces"), F.col("found")))
    # a run has 16 code points at least, so three to the left and two to the right fill the windows
    last, first = F.lit(BEFORE), F.lit(AFTER)
    cut = cut.withColumn("tails", F.transform("found", lambda run, i: F.concat(F.right(F.element_at("pieces", i + 1), last), F.right(run, last))))
    cut = cut.withColumn("heads", F.transform("found", lambda run, i: F.concat(F.left(run, first), F.left(F.element_at("pieces", i + 2), first))))
    left = lambda i: F.right(F.concat(F.array_join(F.slice("tails", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), ""), F.right(F.element_at("pieces", i + 1), last)), last)
    right = lambda i: F.left(F.concat(F.left(F.element_at("pieces", i + 2), first), F.array_join(F.slice("heads", i + 2, F.lit(2)), "")), first)
    near = F.transform(
        F.col("found"),
        lambda run, i: F.struct(
            (F.element_at("offsets", i + 1) + F.length(F.element_at("pieces", i + 1))).alias("start"), run.alias("run"),
            F.right(F.element_at("pieces", i + 1), F.lit(BEFORE)).alias("before"), F.left(F.element_at("pieces", i + 2), F.lit(AFTER)).alias("after"),
            left(i).alias("left"), right(i).alias("right"),
        ),
    )
    each = cut.select("doc", near.alias("near")).select("doc", F.explode_outer("near").alias("x")).where("x is not null")
    return each.select("doc", "x.start", "x.run", "x.before", "x.after", "x.left", "x.right")


def parted(found: DataFrame) -> DataFrame:
    """doc, start, run, before, after of the candidates with the names before their = split off; before and after are the text's own.

    A name long enough to be a candidate is one for itself, without its =.
    """
    rows = found.withColumn("parts", F.split("run", ASSIGNMENT, -1))
    offset = lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
    own = lambda x, i: F.when(i < F.size("parts") - 1, F.regexp_replace(x, "=+$", "")).otherwise(x)
    cut = rows.withColumn("parts", F.transform("parts", lambda x, i: F.struct(own(x, i).alias("run"), offset(i).alias("at"))))
    each = cut.withColumn("x", F.explode(F.filter("parts", lambda x: F.length(x["run"]) >= 16)))
    end = F.col("x.at") + F.length("x.run")
    before = F.right(F.concat("left", F.substr("run", F.lit(1), F.col("x.at"))), F.lit(BEFORE))
    after = F.left(F.concat(F.substr("run", end + 1, F.lit(AFTER)), F.col("right")), F.lit(AFTER))
    return each.select("doc", (F.col("start") + F.col("x.at")).alias("start"), "x.run", before.alias("before"), after.alias("after"))


def features(run: Column, before: Column, after: Column, place: Column) -> dict[str, Column]:
    """What the forest sees of a candidate. place: a path or source of the document, null where there is none."""
    n = F.length(run).cast("double")
    low = F.lower(run)
    kinds = F.translate(run, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", "a" * 26 + "B" * 26 + "1" * 10 + "-" * 5)
    share = lambda pattern: F.regexp_count(run, F.lit(pattern)) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    tail = F.regexp_replace(before, "[^A-Za-z]+$", "")
    return {
        "length": F.log(n),
        "kind_changes": (F.length(F.regexp_replace(kinds, "(.)\\1+", "$1")) - 1) / n,
        "prose_pairs": F.regexp_count(low, F.lit("(?=" + "|".join(PAIRS) + ")")) / n,
        "repeats": F.regexp_count(run, F.lit("(.)(?=\\1)")) / n,
        "different": F.size(F.array_distinct(F.split(run, ""))) / F.least(n, F.lit(36.0)),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "signs": share("[+/_=-]"),
        "hexadecimal": flag(run.rlike("^[0-9a-f]+$") | run.rlike("^[0-9A-F]+$")),
        "dictionary": 1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / n,
        "slashes": share("/"),
        "in_path": flag(before.rlike("[/\\\\.~]$") | after.rlike("^[/\\\\.][A-Za-z]")),
        "test_place": flag(place.rlike("(?i)(^|[/_.-])(test|tests|example|examples|fixture|fixtures|docs?|sample)([/_.-]|$)")),
        "assigned": flag(before.rlike("[:=][^A-Za-z0-9]{0,8}$")),
        "quoted": flag(before.rlike("[\"'`]$")),
        "secret_word_next": flag(tail.rlike(f"(?i)({SECRET_WORDS})[A-Za-z_]{{0,12}}$")),
        "secret_word_near": flag(before.rlike(f"(?i)({SECRET_WORDS})") | run.rlike("^(AKIA|ASIA|gh[pousr]_|sk_live_|xox[bap]-)")),
        "other_word_near": flag(before.rlike(f"(?i)({OTHER_WORDS})")),
    }


def labelled_findings(spark: SparkSession, rows: int = 8_000) -> DataFrame:
    """run, before, after, place, label, kind: findings made from hashes, half of them secrets; kind is the number of what made them, secrets' from 0 and others' from 100."""
    seed = lambda k: F.sha2(F.concat_ws(":", F.lit(k), F.col("id")), 256)
    pick = lambda k, *of: F.element_at(F.array(*[F.lit(x) for x in of]), F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(of))).cast("int") + 1)
    some = lambda k, a, b: (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(b - a + 1)) + a).cast("int")
    code = F.regexp_replace(F.base64(F.unhex(F.concat(seed("c"), seed("d")))), "=", "")
    alphanumeric = F.regexp_replace(code, "[+/]", "")

    def words(of: list[str], count: Column, between: str) -> Column:
        one = lambda i: F.element_at(F.array(*[F.lit(x) for x in of]), F.pmod(F.xxhash64(F.lit("w"), "id", i), F.lit(len(of))).cast("int") + 1)
        return F.array_join(F.transform(F.sequence(F.lit(1), count), one), between)

    prose = F.concat(words(PAIRS, F.lit(4), ""), F.lit(" "), words(PAIRS, F.lit(3), ""), F.lit(", "), words(PAIRS, some("p", 1, 4), ""), F.lit(" "))
    name = pick("n", "token", "secret", "password", "api_key", "API-KEY", "access_key", "auth_token", "client_secret", "TOKEN", "db_passwd", "credentials", "private_key")
    sign = pick("s", ' = "', "=", ": ", ":'", ' => "', " == ", " := `", ' : "', " = ", '": "')
    secret = [
        (F.substring(seed("a"), 1, 40), F.concat(prose, name, sign)),
        (F.substring(seed("a"), 1, 32), F.concat(prose, name, sign)),
        (F.substr(alphanumeric, F.lit(1), some("l", 20, 60)), F.concat(prose, name, sign)),
        (F.substr(code, F.lit(1), some("l", 24, 84)), F.concat(name, sign)),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(alphanumeric, 1, 16))), F.concat(pick("o", "", "aws_access_key_id"), sign)),
        (F.concat(pick("g", "ghp_", "sk_live_", "xoxb-"), F.substring(alphanumeric, 1, 36)), F.concat(prose, pick("o", "", "export KEY"), pick("q", "=", " ", ": "))),
        (F.substr(code, F.lit(1), some("l", 30, 80)), F.concat(prose, F.lit("Authorization: Bearer "))),
        (F.concat_ws("-", F.substring(seed("a"), 1, 8), F.substring(seed("a"), 9, 4), F.substring(seed("a"), 13, 4), F.substring(seed("a"), 17, 12)), F.concat(name, sign)),
    ]
    other = [
        (words(PAIRS, some("l", 8, 18), ""), prose),
        (F.initcap(words(PAIRS, some("l", 8, 14), "")), F.concat(prose, pick("e", ". ", "\n", "", "! ", "=", ": "))),
        (words(PAIRS, some("l", 8, 14), ""), F.concat(prose, pick("e", "the token ", "a secret ", "this password ", "auth "), words(PAIRS, F.lit(2), ""), F.lit(" "))),
        (F.upper(words(PAIRS, some("l", 8, 14), "")), F.concat(F.upper(prose), pick("e", ": ", "- ", " "))),
        (F.substring(seed("a"), 1, 40), F.concat(prose, pick("h", "commit ", "sha1: ", "checksum=", "Merge revision ", "hash = ", 'etag: "'))),
        (F.substr(seed("a"), F.lit(1), some("l", 32, 64)), F.concat(pick("h", "md5 ", "sha256:", "digest: ", "integrity ", "build "), pick("q", "", "is ", "= "))),
        (F.concat_ws("-", F.substring(seed("a"), 1, 8), F.substring(seed("a"), 9, 4), F.substring(seed("a"), 13, 4), F.substring(seed("a"), 17, 12)), F.concat(prose, pick("h", "uuid: ", "id=", "urn:uuid:"))),
        (F.concat(F.lit("/"), words(DICTIONARY, some("l", 3, 7), "/")), F.concat(prose, pick("e", "in ", "path=", "file:/", "cd "))),
        (words(DICTIONARY, some("l", 3, 6), "_"), F.concat(prose, pick("e", "", "token = ", "password: ", "def "))),
        (F.regexp_replace(F.initcap(words(DICTIONARY, some("l", 3, 6), " ")), " ", ""), F.concat(prose, pick("e", "", "secret = ", "new ", "import "))),
        (F.concat(pick("e", "your_", "example-", "my_", "insert_", "placeholder_"), words(DICTIONARY, F.lit(2), "_"), pick("h", "_here", "-example", "_token", "_key_xxx")), F.concat(name, sign)),
        (F.repeat(pick("e", "x", "0", "*a", "abc", "1234567890", "-", "="), some("l", 16, 24)), F.concat(pick("h", "", "\n", "token = ", "password="))),
        (F.lpad(F.substring(F.abs(F.xxhash64("id")).cast("string"), 1, 16), 16, "4"), prose),
        (words(DICTIONARY, some("l", 4, 8), "-"), F.concat(pick("h", "https://www.example.com/", "href=\"/", "see "), words(DICTIONARY, F.lit(1), ""), F.lit("/"))),
        (F.substr(code, F.lit(1), some("l", 60, 84)), F.concat(prose, F.lit("data:image/png;base64,"))),
        (words(DICTIONARY, some("l", 3, 5), "="), F.concat(prose, pick("e", "?", "&", "config: "))),
    ]

    def chosen(of: list[tuple[Column, Column]], lead: int) -> Column:
        which = F.pmod(F.xxhash64(F.lit("kind"), "id"), F.lit(len(of)))
        one = lambda k: F.struct(of[k][0].alias("run"), of[k][1].alias("before"), F.lit(lead + k).alias("kind"))
        out = one(0)
        for k in range(len(of)):
            out = F.when(which == k, one(k)).otherwise(out)
        return out

    label = (F.col("id") % 2).cast("int")
    made = spark.range(0, rows, 1, 4).select("id", label.alias("label"), F.when(label == 1, chosen(secret, 0)).otherwise(chosen(other, 100)).alias("x"))
    after = pick("t", '" ', '"', " ", "'\n", "; ", ", ", ".", '")')
    place = F.when(label == 0, pick("f", "src1", "src2", "tests/unit", "docs", "web", "src3")).otherwise(pick("f", "src1", "src2", "src3", "web", "app/config", "tests/unit"))
    texts = made.select(F.concat("x.before", "x.run", after).alias("text"), F.length("x.before").alias("at"), F.length("x.run").alias("n"), place.alias("place"), "label", "x.kind")
    # what stands beside a secret, as its name, is none
    secret_here = (F.col("doc.label") == 1) & (F.col("start") < F.col("doc.at") + F.col("doc.n")) & (F.col("start") + F.length("run") > F.col("doc.at"))
    return parted(candidates(texts)).select("run", "before", "after", "doc.place", secret_here.cast("int").alias("label"), "doc.kind")


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest over the features of labelled findings (run, before, after, place, label), of TRAINING_ROWS at most."""
    used = findings.orderBy(F.xxhash64("run", "before", "after")).limit(TRAINING_ROWS)
    x = used.select(F.col("label").cast("double").alias("label"), *[c.alias(n) for n, c in features(F.col("run"), F.col("before"), F.col("after"), F.col("place")).items()])
    # the forest reads its rows several times: once made they are a small table
    names, x = x.columns[1:], materialize(x, "secret-features")
    data = VectorAssembler(inputCols=names, outputCol="features").transform(x).select("label", "features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", minInstancesPerNode=3).fit(data)
    release(x)
    return model


def rate(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """found (run, before, after, place and others) with a column score: the forest's probability of a secret."""
    made = features(F.col("run"), F.col("before"), F.col("after"), F.col("place"))
    rows = found.select(F.struct(*[F.col(f"`{c}`") for c in found.columns]).alias("own"), *[c.alias(n) for n, c in made.items()])
    rated = model.transform(VectorAssembler(inputCols=list(made), outputCol="features").transform(rows))
    return rated.select("own.*", vector_to_array("probability")[1].alias("score"))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every secret found: the document's other columns with start, secret, score (in place of columns so named), without text.

    findings: labelled findings to learn from; without them the generated ones. source, where docs has it, is the place.
    A candidate is a run of 16 or more letters, digits and + / _ = -; shorter passwords, and the parts of those with other
    signs that are shorter, are no candidates and are never found.
    Null and empty texts hold none; repeated rows give repeated findings; equal secrets are found wherever they stand.
    No documents: no rows.
    """
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    place = F.col("doc.source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rated = rate(parted(candidates(docs)).withColumn("place", place), model).where(F.col("score") >= threshold)
    return unpacked(rated, [c for c in docs.columns if c != "text"], start=F.col("start"), secret=F.col("run"), score=F.col("score"))
