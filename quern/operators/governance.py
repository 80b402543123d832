"""Data governance: quality rules, profiles, scans for personal data, key discovery, masking and row filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of personal data, in the dialect that Java, RE2 and Python share. The first five are those of whole
#: values, here found between other characters; the address is known by how places end.
PATTERNS = {
    "id_card": r"(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9Xx])",
    "mobile": r"(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])",
    "email": r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}",
    "bank_card": r"(^|[^0-9])[0-9]{16,19}($|[^0-9])",
    "address": r"(省|市|区|县|路|街|号|镇|村)",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "phone": r"\+?[0-9][0-9 ()-]{7,}[0-9]",
}
#: The same patterns as Java matches them fastest, and what a text must hold for a pattern to be tried at all. ipv4, phone and the
#: borders around values are this library's own; the rest are fixed values.
FASTER = {
    "id_card": (r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9Xx])", "[0-9]"), "mobile": (r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])", "[0-9]"), "email": (PATTERNS["email"], "@"),
    "bank_card": (r"(?<![0-9])[0-9]{16,19}(?![0-9])", "[0-9]"), "address": ("[省市区县路街号镇村]", None), "ipv4": (PATTERNS["ipv4"], "[0-9]"), "phone": (PATTERNS["phone"], "[0-9]"),
}
#: Kinds of personal data that names of columns hint at, in the order in which they are tried, with level, tags and words.
NAMES = (
    ("id_card", "secret", ("PII", "ID_CARD"), ("idcard", "id_card", "identity_card", "identity_no", "citizen_id", "身份证", "证件号")),
    ("passport", "secret", ("PII", "PASSPORT"), ("passport", "护照")),
    ("bank_card", "secret", ("PII", "BANK_CARD"), ("bank_card", "bankcard", "card_no", "account_no", "银行卡", "卡号")),
    ("phone", "confidential", ("PII", "PHONE"), ("phone", "mobile", "telephone", "手机", "电话")),
    ("email", "confidential", ("PII", "EMAIL"), ("email", "邮箱")),
    ("address", "confidential", ("PII", "ADDRESS"), ("address", "addr", "地址", "住址")),
    ("name", "confidential", ("PII", "NAME"), ("full_name", "fullname", "real_name", "realname", "first_name", "firstname", "last_name", "lastname", "fname", "lname", "surname", "given_name", "姓名")),
    ("salary", "confidential", ("PII", "SALARY"), ("salary", "wage", "income", "工资", "薪资", "薪酬")),
    ("birth", "confidential", ("PII", "BIRTH"), ("birth", "birthday", "dob", "出生")),
)
NAMES_NOT = ("username", "user_name", "login", "account_name")
#: How secret a level is; others rank above all.
LEVELS = ("public", "internal", "confidential", "secret")
OPERATORS = {
    "mustBe": lambda x, a: x == a[0],
    "mustNotBe": lambda x, a: x != a[0],
    "mustBeGreaterThan": lambda x, a: x > a[0],
    "mustBeGreaterOrEqualTo": lambda x, a: x >= a[0],
    "mustBeLessThan": lambda x, a: x < a[0],
    "mustBeLessOrEqualTo": lambda x, a: x <= a[0],
    "mustBeBetween": lambda x, a: (x >= a[0]) & (x <= a[1]),
    "mustNotBeBetween": lambda x, a: (x < a[0]) | (x > a[1]),
}


@dataclass(frozen=True)
class Rule:
    """A count over a column and the bound it must keep."""

    name: str
    metric: str  # rowCount, nullValues, missingValues, duplicateValues, invalidValues
    column: str | None = None
    operator: str = "mustBe"
    bounds: tuple[float, ...] = (0,)
    missing: tuple[str, ...] = ()
    valid: tuple[str, ...] = ()
    pattern: str | None = None

    def measure(self) -> Column:
        c = F.col(self.column) if self.column else None
        if self.metric == "rowCount":
            return F.count("*")
        if self.metric == "nullValues":
            return F.count_if(c.isNull())
        if self.metric == "missingValues":
            return F.count_if(c.isNull() | c.cast("string").isin(*self.missing))
        if self.metric == "duplicateValues":  # nulls count as duplicates
            return F.count("*") - F.count_distinct(c)
        if self.metric == "invalidValues":  # nulls are not invalid
            return F.count_if(~c.like(self.pattern) if self.pattern else ~c.cast("string").isin(*self.valid))
        raise ValueError(f"unknown metric {self.metric}")


def check(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, measured, passed) of all rules, from one pass over the rows."""
    measured = rows.agg(*[r.measure().cast("long").alias(r.name) for r in rules])
    told = [F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("measured"), OPERATORS[r.operator](F.col(r.name), r.bounds).alias("passed")) for r in rules]
    return measured.select(F.explode(F.array(*told)).alias("x")).select("x.*")


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, non_null, distinct_values, least, greatest) in one pass; bounds are null for columns that are not numbers."""
    kinds = dict(rows.dtypes)
    numeric = lambda c: kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal")
    parts = []
    for c in columns:
        bounds = [f(F.col(c)).cast("double") if numeric(c) else F.lit(None).cast("double") for f in (F.min, F.max)]
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count(c).alias("non_null"), F.count_distinct(c).alias("distinct_values"), bounds[0].alias("least"), bounds[1].alias("greatest")))
    return rows.agg(F.array(*parts).alias("_all")).select(F.explode("_all").alias("x")).select("x.*")


def scan(rows: DataFrame, text: str, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """(kind, rows_hit, share) of the patterns in a column, in one pass.

    A known pattern is tried only in texts that hold what it needs, a digit or an at sign.
    """
    c = F.col(text)

    def hit(kind: str, pattern: str) -> Column:
        if PATTERNS.get(kind) != pattern:
            return c.rlike(pattern)
        fast, needs = FASTER[kind]
        tried = c.rlike(fast)
        return tried if needs is None else F.when(F.contains(c, F.lit(needs)) if needs == "@" else F.col("_digit"), tried).otherwise(False)

    told = rows.select(text, c.rlike("[0-9]").alias("_digit")).agg(F.count("*").alias("_n"), *[F.count_if(hit(k, p)).alias(k) for k, p in patterns.items()])
    parts = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("rows_hit"), F.round(F.col(k) / F.when(F.col("_n") != 0, F.col("_n")), 6).alias("share")) for k in patterns]
    return told.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def masked(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Columns hidden by rule: null, hash (SHA-256 of the text) or partial (all but the last four characters)."""
    how = {"null": lambda c: F.lit(None).cast(rows.schema[c].dataType), "hash": lambda c: F.sha2(F.col(c).cast("string"), 256)}
    how["partial"] = lambda c: F.concat(F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(F.col(c)) - 4)), F.right(F.col(c), F.lit(4)))
    return rows.withColumns({c: how[rule](c) for c, rule in rules.items()})


def permitted(rows: DataFrame, predicates: list[str]) -> DataFrame:
    """Rows that any of the predicates lets through; without predicates none."""
    return rows.where(reduce(lambda a, b: a | b, [F.expr(p) for p in predicates], F.lit(False)))


def containment(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """How many different values of a column another holds: a hint at a foreign key."""
    own = child.select(F.col(child_column).alias("v")).where("v is not null").distinct()
    known = parent.select(F.col(parent_column).alias("w")).distinct()
    both = own.join(known, own.v == known.w, "left")
    return both.agg(F.count("v").alias("distinct_values"), F.count("w").alias("contained"), F.round(F.count("w") / F.when(F.count("v") != 0, F.count("v")), 6).alias("containment"))


def named_kinds(columns: DataFrame) -> DataFrame:
    """columns (column_name, ...) with kind, level and tags of the personal data that a name hints at: those of the first rule that holds.

    Words in ASCII are bounded by anything but letters and digits, others may stand anywhere. Names that end in _id hint at nothing,
    names of accounts are no names of people, and a column that is just called name is one of people. Null where nothing is hinted at.
    """
    low = F.lower("column_name")
    found = F.when(low.isNull(), F.lit(None))
    told = lambda kind, level, tags: F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), F.array(*map(F.lit, tags)).alias("tags"))
    for kind, level, tags, words in NAMES:
        bare, other = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
        hit = low.rlike(f"(^|[^a-z0-9])({'|'.join(bare)})($|[^a-z0-9])") | low.rlike("|".join(other))
        if kind == "name":
            hit = hit & ~low.rlike("|".join(NAMES_NOT))
        found = found.when(~low.endswith("_id") & hit, told(kind, level, tags))
    found = found.when(low == "name", told("name", "confidential", ("PII", "NAME")))
    return columns.withColumn("_told", found).select(*columns.columns, "_told.kind", "_told.level", "_told.tags")


def rank(level: Column) -> Column:
    """A level as a number from 0; unknown ones rank above all, null below."""
    found = F.when(level.isNull(), -1)
    for i, name in enumerate(LEVELS):
        found = found.when(level == name, i)
    return found.otherwise(1_000_000)


def inherited(rows: DataFrame, levels: list[str]) -> Column:
    """The first level that is set among columns, the most particular first: asset, table, collection, tenant."""
    return F.coalesce(*[F.col(c) for c in levels])


def decided(columns: DataFrame, policies: DataFrame, clearance: str) -> DataFrame:
    """(table_name, column_name, effect, policy, mask) for each of columns (table_name, column_name, level).

    policies has id, table_name, column_pattern (a LIKE pattern, null for all), effect (deny, mask, allow), priority,
    min_clearance and mask. Denials and masks hold for clearances below theirs, permissions from theirs on. Deny goes before
    mask before allow, then the higher priority, then the smaller id. Without one the level decides: enough clearance reads,
    confidential columns are masked, others denied. Policies are few beside columns and are broadcast by Spark if small.
    """
    own = F.lit(LEVELS.index(clearance))
    below = own < rank(F.coalesce(F.col("p.min_clearance"), F.lit("public")))
    order = F.when((F.col("p.effect") == "deny") & below, 0).when((F.col("p.effect") == "mask") & below, 1).when((F.col("p.effect") == "allow") & ~below, 2)
    on = (F.col("c.table_name") == F.col("p.table_name")) & (F.col("p.column_pattern").isNull() | F.expr("c.column_name LIKE p.column_pattern"))
    told = columns.alias("c").join(policies.alias("p"), on, "left").select("c.*", order.alias("_o"), (-F.col("p.priority")).alias("_q"), F.col("p.id").alias("_id"), F.col("p.effect").alias("_e"), F.col("p.mask").alias("_m"))
    best = told.groupBy("table_name", "column_name").agg(F.first("level").alias("level"), F.min(F.when(F.col("_o").isNotNull(), F.struct("_o", "_q", "_id", "_e", "_m"))).alias("b"))
    standard = F.when(F.col("level").isNull() | (own >= rank(F.col("level"))), "allow").when(F.col("level") == "confidential", "mask").otherwise("deny")
    mask = F.when(F.col("b").isNotNull(), F.when(F.col("b._e") == "mask", F.coalesce("b._m", F.lit("null")))).when(standard == "mask", "null")
    return best.select("table_name", "column_name", F.coalesce("b._e", standard).alias("effect"), F.col("b._id").alias("policy"), mask.alias("mask"))


def readable(rows: DataFrame, decisions: list[tuple[str, str, str | None]]) -> DataFrame:
    """rows as decisions (column, effect, mask) let them be read: denied columns go, masked ones are hidden."""
    return masked(rows.drop(*[c for c, effect, _ in decisions if effect == "deny"]), {c: mask or "null" for c, effect, mask in decisions if effect == "mask"})


def transitions(last: DataFrame, now: DataFrame) -> DataFrame:
    """(rule, issue) of what a run of rules (rule, outcome) does to open issues (rule): opened, kept, closed; errors leave them be."""
    both = now.join(last.select("rule", F.lit(True).alias("_open")), "rule", "full_outer")
    issue = F.when(F.col("outcome") == "failed", F.when(F.col("_open"), "kept").otherwise("opened")).when((F.col("outcome") == "passed") & F.col("_open"), "closed").when(F.col("_open"), "kept")
    return both.select("rule", issue.alias("issue")).where("issue is not null")


def containments(pairs: list[tuple[DataFrame, str, DataFrame, str]], least: float = 0.8, least_values: int = 10) -> list[dict]:
    """For pairs of columns their containment both ways and which is the foreign key: the side that is held; if both are, that with fewer different values."""
    found = []
    for one, a, two, b in pairs:
        left, right = one.select(F.col(a).alias("v")).where("v is not null").distinct(), two.select(F.col(b).alias("w")).where("w is not null").distinct()
        n, m, shared = left.join(right, F.col("v") == F.col("w"), "full_outer").agg(F.count("v"), F.count("w"), F.count_if(F.col("v").isNotNull() & F.col("w").isNotNull())).first()
        ways = [k for k, size in (("left", n), ("right", m)) if min(n, m) >= least_values and shared / size >= least]
        found.append({"left": a, "right": b, "foreign": min(ways, key={"left": n, "right": m}.get) if ways else None, "shared": shared})
    return found
