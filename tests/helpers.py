"""Hand-written messages, and where the tables are."""

import os

from parkpulse.functions import vocabulary as V

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")
RAW_SCHEMA = "row_id bigint, sensor string, payload string, send_ts string"


def payload(detector, action, fault="0.0", battery="3.6"):
    return (
        f"장치구분: 주차검지센서, 검지기: {detector}, 배터리: {battery}, 장애: {fault}, "
        f"RSSI: -70, SNR: 5, 동작: {action}"
    )


def raw_messages(spark, rows, sensor="주차센서_대신졸음쉼터_#01"):
    """rows: (send_ts, detector, action) or (send_ts, detector, action, sensor)."""
    data = [
        (i, r[3] if len(r) > 3 else sensor, payload(r[1], r[2]), r[0])
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, RAW_SCHEMA)


def park(ts, action=V.EVENT, *rest):
    return (ts, V.PARK, action, *rest)


def depart(ts, action=V.EVENT, *rest):
    return (ts, V.DEPART, action, *rest)


def codes(coded):
    return [r.status_code for r in coded.orderBy("row_id").collect()]


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def plan_nodes(df, subqueries=False):
    """(name, description) of the nodes of a physical plan, as it ran if it has; what is reused counts once."""
    out, seen = [], set()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind.startswith("Reused"):
            return
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            if plan.id() in seen:
                return None
            return walk(plan.plan())
        out.append((plan.nodeName(), plan.simpleString(2000)))
        inner = plan.subqueries() if subqueries else None
        for children in (plan.children(), inner):
            for i in range(children.size() if children else 0):
                walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out
