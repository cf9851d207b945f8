"""How hard a question is, and how a prompt's tokens are shared among its sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of one point and of half a point (one that stands twice counts twice), and shares of a prompt.
HIGH = [
    "sap", "abap", "odata", "hana", "btp", "algorithm", "architecture", "s4hana", "fiori", "cds", "cap", "cloudfoundry", "kyma", "basis", "transport",
    "rfc", "bapi", "idoc", "badi", "user-exit", "enhancement-point", "bopf", "gateway", "soamanager", "lsmw", "slt", "po", "pi", "solman", "charm",
    "tcode", "spa/gko",
]
MIDDLE = [
    "code", "implement", "integration", "database", "api", "endpoint", "navigation", "crud", "build", "design", "framework", "technical", "sql", "json",
    "xml", "config", "debug", "error", "migration", "refactor", "optimize", "troubleshoot", "deploy", "monitor", "deep insert", "function import", "rest",
    "soap", "graphql", "grpc", "oauth", "jwt", "saml", "docker", "kubernetes", "jenkins", "gitlab", "github", "ci/cd", "terraform", "ansible", "helm",
    "istio", "prometheus", "grafana", "postgres", "mongodb", "redis", "kafka", "rabbitmq", "elasticsearch", "firewall", "vpn", "proxy", "load-balancer",
    "dns", "tls", "ssl", "microservices", "event-driven", "cqrs", "saga", "ddd", "unit-test", "integration-test", "e2e", "tdd", "mocking", "swagger",
    "openapi", "raml", "postman", "curl", "performance", "latency", "throughput", "scalability", "authentication", "authorization", "rbac", "abac", "acl",
    "pipeline", "workflow", "orchestration", "scheduler", "serverless", "lambda", "ec2", "s3", "rds", "sns", "sqs", "azure", "aws", "gcp", "cloud",
    "vmware", "hypervisor", "sap-fiori", "sap-cloud-platform", "sap-hana", "sap-s4", "billing", "invoice", "purchase-order", "sales-order", "warehouse",
    "inventory", "logistics", "supply-chain", "master-data", "business-partner", "material", "pricing", "workflow", "approval", "release-strategy",
    "output-type", "batch-job", "background-job", "job-scheduling", "authorization-object", "role", "profile", "user-group", "performance-tuning",
    "indexing", "partitioning", "caching",
]
PATTERNS = {"select\\s+[^\\n\\r]*\\s+from": 1.0, "create\\s+(table|view|proc|function|index)": 1.0}
MARKUP, CALL, PAIR = "<[A-Za-z]+[\\s>]", "[A-Z]\\w*\\([^)]*\\)", '"[^"]+"\\s*:'
STATIC = {"system": 0.10, "history": 0.30, "rag": 0.15, "file": 0.15, "tool_loop": 0.15}
REST = {"system": 0.14, "rag": 0.26, "file": 0.26}


def _held(text: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))).cast("double")


def complexity(question: Column, history: Column | None = None) -> Column:
    """0 to 10, to one decimal: technical words, code, statements, markup, length, and words of the history; null for a null question."""
    low, one = F.lower(question), lambda c, points: F.when(c, points).otherwise(0.0)
    score = F.least(_held(low, HIGH), F.lit(4.0)) + F.least(_held(low, MIDDLE) * 0.5, F.lit(3.0)) + one(question.contains("```"), 1.5)
    for pattern, points in PATTERNS.items():
        score += one(low.rlike(pattern), points)
    inside = F.substring(question, F.locate("{", question), F.length(question))  # from the first brace on
    score += one(question.rlike(MARKUP), 0.5) + one(question.contains("{") & inside.rlike(PAIR), 0.5) + one(question.rlike(CALL), 0.5)
    score += F.least(F.size(F.split(question, r"\s+")) / 80.0, F.lit(2.5))
    if history is not None:
        past = F.lower(history)
        score += F.coalesce(F.least(_held(past, HIGH) * 0.4 + _held(past, MIDDLE) * 0.15, F.lit(2.0)), F.lit(0.0))
    return F.when(question.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.floor(score * 10 + 0.5) / 10)))


def _share(total: Column, share: float | Column) -> Column:
    return F.floor(total * (F.lit(share) if isinstance(share, float) else share))


def prompt_budget(limit: Column) -> Column:
    """A struct of the tokens of each section of a prompt for a model's ``limit``; the query takes the remainder."""
    out = F.when(limit >= 32000, 4000).otherwise(F.least(F.lit(4000), F.greatest(F.lit(800), F.floor(limit * F.lit(0.35)))))
    most = F.greatest(F.lit(1200), limit - out).cast("long")
    parts = {name: _share(most, share) for name, share in STATIC.items()}
    rest = F.greatest(F.lit(0), most - sum(parts.values(), F.lit(0)))
    return F.struct(most.alias("prompt"), *[v.alias(k) for k, v in parts.items()], rest.cast("long").alias("query"))


def dynamic_budget(turns: Column, score: Column, limit: Column) -> Column:
    """As ``prompt_budget``, with a share of the history that grows with the turns and the complexity of a conversation."""
    out = F.when(limit >= 32000, 4000).otherwise(F.least(F.lit(2000), F.greatest(F.lit(800), F.floor(limit * F.lit(0.25)))))
    most = (limit - out).cast("long")
    loop = _share(most, 0.12)
    ratio = F.when(turns < 3, 0.25).when((score > 7) | (turns > 10), 0.65).when(score > 5, 0.50).otherwise(0.45)
    history = _share(most - loop, ratio)
    left = most - loop - history
    parts = {name: _share(left, share) for name, share in REST.items()}
    rest = F.greatest(F.lit(0), left - sum(parts.values(), F.lit(0)))
    return F.struct(
        most.alias("prompt"), loop.alias("tool_loop"), history.alias("history"), *[v.alias(k) for k, v in parts.items()], rest.cast("long").alias("query")
    )
