"""Walks an executed plan, through adaptive stages and subqueries."""


def plan_nodes(df):
    """Descriptions of all nodes that were run; reused parts appear once."""
    df.collect()
    found, todo, seen = [], [df._jdf.queryExecution().executedPlan()], set()

    def add(seq):
        todo.extend(seq.apply(i) for i in range(seq.size()))

    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind in ("ReusedExchangeExec", "ReusedSubqueryExec"):
            continue
        elif kind == "SubqueryExec" and node.id() in seen:
            continue
        else:
            seen.add(node.id())
            found.append((kind, node.verboseStringWithOperatorId()))
            add(node.children())
            add(node.subqueries())
    return found


def input_rows(df, kind):
    """For each node of a kind that was run, the rows that came out of what feeds it.

    Below a window that is the shuffle or the aggregation before it.
    """
    df.collect()
    found = []

    def children(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return [node.executedPlan()]
        if name.endswith("QueryStageExec"):
            return [node.plan()]
        seq = node.children()
        return [seq.apply(i) for i in range(seq.size())]

    def rows(node):
        for metric in ("numOutputRows", "shuffleRecordsWritten"):
            value = node.metrics().get(metric)
            if value.isDefined() and value.get().value() > 0:
                return value.get().value()
        below = children(node)
        return rows(below[0]) if below else 0

    def walk(node):
        if node.getClass().getSimpleName() == kind:
            found.append(rows(children(node)[0]))
        for child in children(node):
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return found


def count(nodes, kind, text=""):
    return sum(k == kind and text in description for k, description in nodes)
