"""What a finished query did, read from its executed plan."""
from __future__ import annotations


def _nodes(plan):
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from _nodes(plan.executedPlan())
        return
    if name.endswith("QueryStage"):
        yield from _nodes(plan.plan())
        return
    yield plan
    kids = plan.children()
    for i in range(kids.size()):
        yield from _nodes(kids.apply(i))


def run(df):
    """The rows of a query and the nodes of its final plan."""
    plan = df._jdf.queryExecution().executedPlan()
    count = plan.executeCollect().__len__()
    return count, list(_nodes(plan))


def metric(nodes, kind: str, name: str) -> list[int]:
    """The values of a metric in all nodes whose name begins with ``kind``."""
    return [n.metrics().apply(name).value() for n in nodes if n.nodeName().startswith(kind) and n.metrics().contains(name)]
