"""Registered queries of the feedback engine over the relational tables, each with the SQL that gives the same rows.

Mentions come from order lines: an order is a document, a part's brand a theme, a customer an account.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import ENGLISH
from ..functions.ranking import tasks_for
from ..functions.shared import saved
from ..functions.sentiment import rating_sentiment, text_sentiment
from ..functions.text import fold, redact, segment_feedback
from ..operators import evaluate, impact, mentions, scoring, stats, themes, trends


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = _t(spark, d, "orders"), _t(spark, d, "customer")
    fb = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return fb.select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("account_id"), F.greatest("c_acctbal", F.lit(0.0)).alias("mrr"),
        F.col("c_mktsegment").alias("plan"), F.col("o_orderpriority").alias("channel"), ((F.col("o_orderkey") % 21 - 10) / 10.0).cast("double").alias("sentiment"),
    )


def _mentions(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """only: the feedback looked at; other orders' lines go before they are grouped. Both sides lie by order, in as many parts as the lines ask for, so later steps by order need no other shuffle and no task grows with the tables."""
    lines, part = _t(spark, d, "lineitem"), _t(spark, d, "part")
    parts = tasks_for(lines)
    segments = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"), F.col("p_brand").alias("theme_id")).repartition(parts, "doc_id")
    feedback = (_feedback(spark, d) if only is None else only).repartition(parts, "doc_id")
    if only is not None:
        segments = segments.join(feedback.select("doc_id"), "doc_id", "left_semi")
    return mentions.mentions_of(segments, feedback)


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, d, "events").select(F.col("event_id").alias("doc"), F.col("event_type").alias("theme_id"), F.col("ts").alias("created_at"))
    return e, e.select("created_at")


def _last(df: DataFrame):
    return F.lit(df.agg(F.max("created_at")).first()[0])


_r = lambda c, n=6: F.round(F.col(c), n).alias(c)

FB = "fb as (select o_orderkey as doc, o_orderdate as created_at, o_custkey as account_id, greatest(c_acctbal, 0) as mrr, c_mktsegment as plan, o_orderpriority as channel, cast(o_orderkey % 21 - 10 as double) / 10 as sentiment from orders join customer on o_custkey = c_custkey)"
M = FB + ", seg as (select l_orderkey as doc, p_brand as theme_id, min(l_linenumber) as position from lineitem join part on l_partkey = p_partkey group by 1, 2), m as (select *, row_number() over (partition by doc order by position, theme_id) = 1 as prim from seg join fb using (doc))"
WINDOW = ", lastday as (select max(created_at) as t from fb), w as (select m.* from m, lastday where created_at < date_trunc('day', t) + interval 1 day and created_at >= date_trunc('day', t) - interval 59 day), nd as (select count(*) as n from fb, lastday where created_at < date_trunc('day', t) + interval 1 day and created_at >= date_trunc('day', t) - interval 59 day)"
METRICS = ", wt as (select account_id, count(*) as k from w group by 1), ex as (select theme_id, sum(mrr) as mrr_exposed, count(*) as accounts from (select distinct theme_id, account_id, mrr from w) group by 1), tm as (select theme_id, count(distinct doc) as mentions, sum(prim::int)::bigint as primary_mentions, sum(mrr / k) as mrr_weighted, avg(sentiment) as mean_sentiment, avg((sentiment < -0.2)::int) as negative_share, min(created_at) as first_seen, max(created_at) as last_seen from w join wt using (account_id) group by 1)"


def theme_metrics(spark: SparkSession, d: str) -> DataFrame:
    fb = _feedback(spark, d)
    as_of = _last(fb)
    window = mentions.score_window(fb, as_of)
    got = mentions.theme_metrics(_mentions(spark, d, window), window.count())
    return got.select("theme_id", "mentions", "primary_mentions", "accounts", _r("mrr_exposed", 2), _r("mrr_weighted", 4), _r("mean_sentiment"), _r("negative_share"), "first_seen", "last_seen", _r("share"))


def theme_mix(spark: SparkSession, d: str) -> DataFrame:
    return mentions.mix(_mentions(spark, d), "plan").select("theme_id", F.explode("plan_mix").alias("plan", "share"))


def weekly(spark: SparkSession, d: str) -> DataFrame:
    return mentions.weekly_mentions(_mentions(spark, d), _feedback(spark, d))


def daily_trailing(spark: SparkSession, d: str) -> DataFrame:
    return mentions.trailing(mentions.daily_grid(_events(spark, d)[0]))


def alert_episodes(spark: SparkSession, d: str) -> DataFrame:
    return mentions.episodes(daily_trailing(spark, d).filter("n >= prior28 / 28 and n > 0"))


def early_warnings(spark: SparkSession, d: str) -> DataFrame:
    m, fb = _events(spark, d)
    got = trends.detect_trends(m, fb, _last(fb), recent_days=7, baseline_days=21)
    return got.select("theme_id", "recent_mentions", "baseline_mentions", _r("recent_share"), _r("baseline_share"), _r("lift"), _r("p_value"), _r("q_value"), "status")


def false_discovery(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("test"), F.col("p_size").alias("family"), (F.pmod(F.col("p_partkey") * 7919, F.lit(10007)) / 10007.0).alias("p_value"))
    return stats.benjamini_hochberg(part, by=("family",)).select("family", "test", _r("p_value", 8), _r("q_value", 8))


def priority_scores(spark: SparkSession, d: str) -> DataFrame:
    got = theme_metrics(spark, d)
    kinds = F.when(F.substring("theme_id", -1, 1) == "5", "praise").otherwise("bug")
    fed = got.withColumns({"kind": kinds, "lift": 1 + F.col("negative_share") * 2, "status": F.when(F.col("mentions") % 2 == 0, "rising").otherwise("stable")})
    scored = scoring.score_themes(fed)
    return scored.select("theme_id", "kind", _r("c_reach"), _r("c_revenue"), _r("c_severity"), _r("c_momentum"), _r("score"), "rank", "vote_rank", "rank_shift")


RELEASES = (("1.0", 5, "a"), ("1.1", 12, "click"), ("1.2", 18, "purchase"), ("1.3", 40, None))


def _releases(spark: SparkSession, d: str) -> DataFrame:
    first = _t(spark, d, "events").agg(F.min("ts").alias("t"))
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(k).alias("k"), F.lit(x).cast("string").alias("theme_id")) for v, k, x in RELEASES])).alias("x")
    return first.select("t", rows).select("x.version", F.date_add(F.to_date("t"), F.col("x.k")).alias("date"), F.concat(F.lit("Release "), "x.version").alias("title"), "x.theme_id")


def release_radar(spark: SparkSession, d: str) -> DataFrame:
    m, fb = _events(spark, d)
    radar, _ = impact.release_radar(m, fb, _releases(spark, d), days=7)
    return radar.select("version", "day", "theme_id", "pre_days", "post_days", "pre_mentions", "post_mentions", _r("rate_ratio"), _r("p_value"))


def release_verdicts(spark: SparkSession, d: str) -> DataFrame:
    m, fb = _events(spark, d)
    radar, effects = impact.release_radar(m, fb, _releases(spark, d), days=7)
    n = effects.groupBy("version").agg(F.count(F.lit(1)).alias("effects"))
    return radar.join(n, "version", "left").select("version", _r("ci_low"), _r("ci_high"), "verdict", F.coalesce("effects", F.lit(0)).alias("effects"))


def theme_agreement(spark: SparkSession, d: str) -> DataFrame:
    got = evaluate.agreement(evaluate.contingency(_t(spark, d, "documents"), "lang", "source"))
    return got.select("items", *[_r(c) for c in ("adjusted_rand", "nmi", "homogeneity", "completeness")])


def theme_recovery(spark: SparkSession, d: str) -> DataFrame:
    got = evaluate.recovery(evaluate.contingency(_t(spark, d, "documents"), "lang", "source"))
    return got.select("true_theme", "items", _r("recovered_share"), "themes", "largest_theme", _r("largest_theme_share"), _r("largest_theme_purity"))


def rating_scores(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part").select("p_partkey", (F.col("p_size") % 11).cast("double").alias("rating"), F.when(F.col("p_size") % 2 == 0, "survey").otherwise("app_store").alias("channel"))
    return part.select("p_partkey", rating_sentiment(F.col("rating"), F.col("channel")).alias("sentiment"))


def folded(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(fold(F.col("text"))).alias("folded"))


def accounts_joined(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = _t(spark, d, "orders"), _t(spark, d, "customer")
    fb = orders.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") + 3).alias("account_id"))
    acc = customer.select(F.col("c_custkey").alias("account_id"), F.greatest("c_acctbal", F.lit(0.0)).alias("mrr"), F.col("c_mktsegment").alias("plan"))
    return mentions.with_accounts(fb, acc).groupBy("plan").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("mrr"), 2).alias("mrr"))


def theme_centroids(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    centers = themes.centroids(v)
    return themes.cohesion(v, centers).join(centers, "label").select("label", "size", _r("cohesion", 5), F.round(F.element_at("centroid", 1), 5).alias("first_component"))


def nearest_theme(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    got = themes.nearest(v.drop("label"), themes.centroids(v), 0.2)
    return got.select("vec_id", "label", F.round("similarity", 5).alias("similarity"))


def theme_keywords(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("lang").alias("theme_id"), "text")
    return themes.keywords(docs).select("theme_id", "term", _r("weight"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    return segment_feedback(_t(spark, d, "documents").select("doc_id", "text"))


def redacted(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", redact(F.col("text")).alias("text"))


def sentiment(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.round(text_sentiment(F.col("text")), 6).alias("sentiment"))


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(mentions, items): every event is an item; views have no theme, and dear events have one more than their type."""
    e = _t(spark, d, "events").select(F.col("event_id").alias("doc"), F.col("event_type").alias("theme_id"), F.col("ts").alias("created_at"), "value")
    typed, dear = e.filter("theme_id != 'view'"), e.filter("value >= 10").withColumn("theme_id", F.lit("dear"))
    return typed.unionByName(dear).drop("value"), e.select("created_at")


def _replay(spark: SparkSession, d: str, method: str = "median_of_ratios") -> DataFrame:
    return trends.backtest(*_items(spark, d), recent_days=5, baseline_days=10, from_day=12, alpha=0.5, method=method)


def backtest(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d).select("day", "theme_id", "recent_mentions", "baseline_mentions", _r("lift"), _r("p_value"), _r("q_value"), "status")


def backtest_by_volume(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d, "total").select("day", "theme_id", "recent_mentions", "baseline_mentions", _r("lift"), _r("p_value"), _r("q_value"), "status")


EVENTS = (("click", 6, 12, "spike"), ("purchase", 3, None, "gradual growth"), ("view", 14, 15, "drop"))


def _known(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Made-up events of known themes, in days from the first; and the themes' true names, which are their own."""
    e = _t(spark, d, "events")
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("theme"), F.lit(a).alias("a"), F.lit(b).cast("int").alias("b"), F.lit(k).alias("kind")) for t, a, b, k in EVENTS])).alias("x")
    at = lambda c: F.date_add(F.to_date("t"), F.col(c))
    events = e.agg(F.min("ts").alias("t")).select("t", rows).select("t", "x.*").select("theme", at("a").alias("start_date"), at("b").alias("end_date"), "kind")
    return events, e.select(F.col("event_type").alias("theme_id")).distinct().withColumn("true_theme", F.col("theme_id"))


def _alert_log(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation's log of the replay, written since its readers read it more than once."""
    events, named = _known(spark, d)
    log = evaluate.alert_log(_replay(spark, d), mentions.trailing(mentions.daily_grid(*_items(spark, d))), named, events, grace=2)
    return saved(log, "alerts")


def alert_log(spark: SparkSession, d: str) -> DataFrame:
    return _alert_log(spark, d)


def alert_detection(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.detection(_alert_log(spark, d), _known(spark, d)[0])


def alert_summary(spark: SparkSession, d: str) -> DataFrame:
    log = _alert_log(spark, d)
    return evaluate.alert_summary(log, evaluate.detection(log, _known(spark, d)[0]))


def sentiment_quality(spark: SparkSession, d: str) -> DataFrame:
    truth = F.element_at(F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")), F.col("p_partkey").cast("int") % 3 + 1)
    part = _t(spark, d, "part").select(((F.col("p_size") % 21 - 10) / 10.0).cast("double").alias("sentiment"), truth.alias("true_polarity"))
    return evaluate.sentiment_quality(part).select("true_polarity", "items", _r("recall"), _r("mean_sentiment"))


def release_matching(spark: SparkSession, d: str) -> DataFrame:
    rel = _releases(spark, d).withColumn("verdict", F.lit("told"))
    intended = spark.createDataFrame([("1.0", "click"), ("1.1", "click"), ("1.2", "view"), ("1.3", "click")], "version string, intended_theme string")
    return evaluate.release_matching(rel, _known(spark, d)[1], intended).select("version", "theme_id", "matched_true_theme", "intended_theme", "correct")


def side_effects_checked(spark: SparkSession, d: str) -> DataFrame:
    events, named = _known(spark, d)
    effects = _releases(spark, d).select("version", F.col("date").alias("day")).crossJoin(named.select("theme_id"))  # releases x themes
    return evaluate.side_effect_precision(effects, named, events)


def score_parts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.contributions(priority_scores(spark, d)).select("theme_id", *[_r(c, 4) for c in ("reach", "revenue", "severity", "momentum")])


def window_counts(spark: SparkSession, d: str) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp")
    return mentions.window_counts(_mentions(spark, d), {"early": (at("1995-01-01"), at("1996-01-01")), "late": (at("1996-01-01"), at("1997-01-01"))})


def first_mentions(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).select("doc", "theme_id", "position", "primary")


def majority_theme(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.majority(evaluate.contingency(_t(spark, d, "documents"), "lang", "source"))


def timeline_shares(spark: SparkSession, d: str) -> DataFrame:
    from .report import timeline

    return timeline(weekly(spark, d)).select("week", "theme_id", "n", _r("percent"))


def release_windows(spark: SparkSession, d: str) -> DataFrame:
    low, high = _t(spark, d, "events").agg(F.min(F.to_date("ts")), F.date_add(F.max(F.to_date("ts")), 1)).first()
    return impact.windows(_releases(spark, d), F.lit(low), F.lit(high), 7).select("version", "pre_start", "pre_end", "post_end")


def _p(a: str, b: str, f: str) -> str:
    term = lambda k: f"(lgamma({a} + {b} + 1) - lgamma({k} + 1) - lgamma({a} + {b} - {k} + 1) + {k} * ln({f} / (1 + {f})) + ({a} + {b} - {k}) * ln(1 / (1 + {f})))"
    return f"case when {a} + {b} = 0 or {f} is null or isnan({f}) then 1.0 else least(1.0, list_sum(list_transform(list_filter(range(0, ({a} + {b} + 1)::bigint), lambda k: {term('k')} <= {term(a)} + ln(1 + 1e-7)), lambda k: exp({term('k')})))) end"


_STATUS_AT = lambda alpha: f"case when a + b < 5 then 'quiet' when q < {alpha} and b = 0 then 'new' when q < {alpha} and lift >= 1.5 then 'emerging' when q < {alpha} and lift > 1 then 'rising' when q < {alpha} and lift < 1 then 'declining' else 'stable' end"
_STATUS = _STATUS_AT(0.05)
_EXPECTED = "case when count(*) filter (a + b >= 10) >= 4 then exp(median(case when a + b >= 10 then ln((a + 0.5) / (b + 0.5)) end)) when max(ta) > 0 and max(tb) > 0 then max(ta)::double / max(tb) else 'nan'::double end"
_AGREE = "with c as (select lang as t, source as p, count(*) as n from documents group by 1, 2), rt as (select t, sum(n) as m from c group by 1), cp as (select p, sum(n) as m from c group by 1)"

_DAILY = "with g as (select day::date as day, theme_id from (select unnest(generate_series((select min(ts)::date from events), (select max(ts)::date from events), interval 1 day)) as day) cross join (select distinct event_type as theme_id from events)), c as (select ts::date as day, event_type as theme_id, count(*) as n from events group by 1, 2), d as (select day, theme_id, coalesce(n, 0) as n from g left join c using (day, theme_id)), s as (select *, sum(n) over (partition by theme_id order by day rows between 6 preceding and current row)::bigint as last7, coalesce(sum(n) over (partition by theme_id order by day rows between 34 preceding and 7 preceding), 0)::bigint as prior28, lag(n) over (partition by theme_id order by day) as before from d)"
_KNOWN = "select theme, lo + a::int as start_date, lo + b::int as end_date, kind from (select min(ts)::date as lo from events), (values " + ", ".join(f"('{t}', {a}, {'null' if b is None else b}, '{k}')" for t, a, b, k in EVENTS) + ") as v(theme, a, b, kind)"
_VOLUME = "case when max(ta) > 0 and max(tb) > 0 then max(ta)::double / max(tb) else 'nan'::double end"


def _replay_sql(expected: str) -> str:
    """The replay: windows of 5 and of 10 days before, from the 13th day of the items on."""
    return f"""
with m as (
  select event_id as doc, ts::date as day, event_type as theme_id from events where event_type != 'view'
  union all select event_id, ts::date, 'dear' from events where value >= 10
), days as (
  select unnest(generate_series(min(ts)::date, max(ts)::date, interval 1 day))::date as day from events
), items as (
  select days.day, count(event_id) as n from days left join events on ts::date = days.day group by 1
), totals as (
  select day, sum(n) over (order by day rows between 4 preceding and current row)::bigint as ta,
    coalesce(sum(n) over (order by day rows between 14 preceding and 5 preceding), 0)::bigint as tb, row_number() over (order by day) as i
  from items
), told as (
  select day, theme_id, count(distinct doc) as n from m group by 1, 2
), dense as (
  select day, theme_id, coalesce(n, 0) as n from days cross join (select distinct theme_id from m) left join told using (day, theme_id)
), s as (
  select day, theme_id, sum(n) over (w rows between 4 preceding and current row)::bigint as a,
    coalesce(sum(n) over (w rows between 14 preceding and 5 preceding), 0)::bigint as b,
    sum(n) over (w rows between 6 preceding and current row)::bigint as last7,
    coalesce(sum(n) over (w rows between 34 preceding and 7 preceding), 0)::bigint as prior28
  from dense window w as (partition by theme_id order by day)
), t as (select s.*, ta, tb from s join totals using (day) where i > 12),
f as (select day, {expected} as f from t group by 1),
r as (select day, theme_id, a, b, last7, prior28, (a + 0.5) / (b + 0.5) / f as lift, {_p("a", "b", "f")} as p from t join f using (day)),
k as (select *, row_number() over (partition by day order by p) as rk, count(*) over (partition by day) as n from r),
q as (select *, least(1, min(p * n / rk) over (partition by day order by rk rows between current row and unbounded following)) as q from k),
replay as (select *, {_STATUS_AT(0.5)} as status from q)
"""


_REPLAYED = "select day, theme_id, a as recent_mentions, b as baseline_mentions, round(lift, 6) as lift, round(p, 6) as p_value, round(q, 6) as q_value, status from replay"
_LOG = _replay_sql(_EXPECTED) + f"""
, known as ({_KNOWN}), raw as (
  select day, 'rate_test' as method, theme_id from replay where status in ('new', 'emerging')
  union all select day, 'naive_2x', theme_id from replay where last7 >= 2 * prior28 / 4 and last7 >= 5
), log as (
  select day, method, theme_id, case when theme_id in (select event_type from events) then theme_id end as true_theme,
    exists (select 1 from known where kind in ('spike', 'gradual growth') and theme = theme_id and day >= start_date and (end_date is null or day <= end_date + 2)) as expected
  from raw
)"""
_DETECTED = "select theme as spike, start_date as started, m.method, min(day) as first_alert, datediff('day', start_date, min(day))::int as days_to_detect from (select * from known where kind = 'spike') cross join (values ('rate_test'), ('naive_2x')) as m(method) left join log on log.method = m.method and true_theme = theme and day >= start_date group by 1, 2, 3"


def _share_sql(a: str, n: str) -> str:
    """Lower Clopper-Pearson bound of a in n: 60 halvings, the tail as a sum of all its probabilities."""
    term = f"exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) + k * ln((s.l + s.h) / 2) + ({n} - k) * ln(1 - (s.l + s.h) / 2))"
    tail = f"list_sum(list_transform(range(({a})::bigint, ({n} + 1)::bigint), lambda k: {term}))"
    halved = f"case when {tail} > 0.025 then {{'l': s.l, 'h': (s.l + s.h) / 2}} else {{'l': (s.l + s.h) / 2, 'h': s.h}} end"
    return f"case when {a} = 0 then 0.0 else list_reduce(list_transform(range(61), lambda i: {{'l': 0.0::double, 'h': 1.0::double}}), lambda s, x: {halved}).l end"


_VERDICTS = f"""
with e as (
  select min(ts)::date as lo, max(ts)::date + 1 as hi from events
), rel as (
  select version, lo + k::int as day, theme_id, lo, hi from e, (values {", ".join(f"('{v}', {k}, " + (repr(x) if x else "null") + ")" for v, k, x in RELEASES)}) as x(version, k, theme_id)
), pl as (
  select version, theme_id, day, greatest(day - 7, coalesce(lag(day) over (order by day), day - 7), lo) as s,
    least(day + 7, coalesce(lead(day) over (order by day), day + 7), hi) as z
  from rel
), tt as (
  select version, count(*) filter (ts::date >= s and ts::date < day) as tb, count(*) filter (ts::date >= day and ts::date < z) as ta from pl, events group by 1
), c as (
  select version, event_type as th, count(*) filter (ts::date >= s and ts::date < day) as b, count(*) filter (ts::date >= day and ts::date < z) as a from pl, events group by 1, 2
), cc as (select c.*, ta, tb from c join tt using (version)),
f as (select version, {_EXPECTED} as f from cc group by 1),
r as (
  select version, th, a, b, ta, tb, f, (a + 0.5) / (b + 0.5) / f as ratio, {_p("a", "b", "f")} as p,
    {_share_sql("a", "(a + b)")} as q0, 1 - {_share_sql("b", "(a + b)")} as q1
  from cc join f using (version) where ta > 0 and tb > 0
), told as (
  select *, q0 / (1 - q0) / f as ci_low, case when q1 >= 1 then 'infinity'::double else q1 / (1 - q1) / f end as ci_high from r
), others as (
  select told.*, row_number() over (partition by version order by p) as rk, count(*) over (partition by version) as n
  from told join pl using (version) where theme_id is null or theme_id != th
), q as (
  select *, least(1, min(p * n / rk) over (partition by version order by rk rows between current row and unbounded following)) as q from others
), effects as (
  select version, count(*) as effects from q where q < 0.05 and ratio >= 1.5 and a >= 5 group by 1
)
select pl.version, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, coalesce(effects, 0) as effects,
  case when coalesce(tt.ta, 0) = 0 or coalesce(tt.tb, 0) = 0 then 'Not enough data' when theme_id is null then 'No matching theme'
    when ratio is null or isnan(ratio) then 'Not enough data'
    when p >= 0.05 and (a + b < 20 or ci_low <= 0 or ci_high / ci_low > 6) then 'Inconclusive' when p >= 0.05 then 'No detectable change'
    when ratio <= 0.5 then 'Resolved' when ratio < 1 then 'Improved' else 'Worse' end as verdict
from pl left join tt using (version) left join told on told.version = pl.version and th = theme_id left join effects on effects.version = pl.version
"""
_RELEASED = ", ".join(f"({v!r}, " + (repr(x) if x else "null") + ")" for v, _, x in RELEASES)
_MAP = lambda d: "map {" + ", ".join(f"'{k}': {v}" for k, v in d.items()) + "}"
_SENTIMENT = (
    "with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[''’]', '', 'g')), '[a-z]+') as w from documents), h as (select doc_id, text, list_sum(list_transform(w, lambda x, i: "
    f"coalesce({_MAP(ENGLISH.lexicon)}[x], 0.0)::double * case when list_has_any(w[greatest(i - 3, 1):i - 1], [{', '.join(repr(x) for x in sorted(ENGLISH.negations_before))}]) then -0.6 else 1.0 end * case when i > 1 then coalesce({_MAP(ENGLISH.intensifiers)}[w[i - 1]], 1.0)::double else 1.0 end)) as t from w), "
    "g as (select doc_id, coalesce(t, 0) + sign(coalesce(t, 0)) * least(length(text) - length(replace(text, '!', '')), 3) * 0.15 as t from h) select doc_id, round(t / sqrt(t * t + 8), 6) as sentiment from g"
)

ORACLE = {
    "theme_metrics": f"with {M}{WINDOW}{METRICS} select theme_id, mentions, primary_mentions, accounts, round(mrr_exposed, 2) as mrr_exposed, round(mrr_weighted, 4) as mrr_weighted, round(mean_sentiment, 6) as mean_sentiment, round(negative_share, 6) as negative_share, first_seen, last_seen, round(mentions / greatest(n, 1), 6) as share from tm join ex using (theme_id), nd",
    "theme_mix": f"with {M}, c as (select theme_id, plan, count(*) as n from m group by 1, 2) select theme_id, plan, round_even(n / sum(n) over (partition by theme_id), 3) as share from c",
    "weekly": f"with {M}, wk as (select date_trunc('week', created_at)::date as week, count(*) as total from fb group by 1), c as (select date_trunc('week', created_at)::date as week, theme_id, count(distinct doc) as n from m group by 1, 2) select week::date as week, theme_id, coalesce(n, 0) as n, total from wk cross join (select distinct theme_id from m) left join c using (week, theme_id)",
    "daily_trailing": "with g as (select day::date as day, theme_id from (select unnest(generate_series((select min(ts)::date from events), (select max(ts)::date from events), interval 1 day)) as day) cross join (select distinct event_type as theme_id from events)), c as (select ts::date as day, event_type as theme_id, count(*) as n from events group by 1, 2), d as (select day, theme_id, coalesce(n, 0) as n from g left join c using (day, theme_id)), s as (select *, sum(n) over (partition by theme_id order by day rows between 6 preceding and current row)::bigint as last7, coalesce(sum(n) over (partition by theme_id order by day rows between 34 preceding and 7 preceding), 0)::bigint as prior28 from d) select *, last7 >= 2 * prior28 / 4 and last7 >= 5 as naive from s",
    "early_warnings": f"with e as (select max(ts) as t, min(ts) as f from events), x as (select date_trunc('day', t) + interval 1 day as hi, date_trunc('day', t) - interval 6 day as mid, greatest(date_trunc('day', t) - interval 27 day, date_trunc('day', f)) as lo from e), tt as (select count(*) filter (ts >= mid and ts < hi) as ta, count(*) filter (ts >= lo and ts < mid) as tb from events, x), c as (select event_type as theme_id, count(*) filter (ts >= mid and ts < hi) as a, count(*) filter (ts >= lo and ts < mid) as b, max(ta) as ta, max(tb) as tb from events, x, tt group by 1), f as (select {_EXPECTED} as f from c), r as (select *, (a + 0.5) / (b + 0.5) / f as lift, {_p('a', 'b', 'f')} as p from c, f), k as (select *, row_number() over (order by p) as rk, count(*) over () as n from r), q as (select *, least(1, min(p * n / rk) over (order by rk rows between current row and unbounded following)) as q from k) select theme_id, a as recent_mentions, b as baseline_mentions, round(a / greatest(ta, 1), 6) as recent_share, round(b / greatest(tb, 1), 6) as baseline_share, round(lift, 6) as lift, round(p, 6) as p_value, round(q, 6) as q_value, {_STATUS} as status from q",
    "false_discovery": "with t as (select p_partkey as test, p_size as family, (p_partkey * 7919 % 10007) / 10007.0::double as p from part), k as (select *, row_number() over (partition by family order by p) as rk, count(*) over (partition by family) as n from t) select family, test, round(p, 8) as p_value, round(least(1, min(p * n / rk) over (partition by family order by rk rows between current row and unbounded following)), 8) as q_value from k",
    "priority_scores": f"with {M}{WINDOW}{METRICS}, t as (select theme_id, mentions, accounts, round(mrr_weighted, 4) as mrr_weighted, round(negative_share, 6) as negative_share, case when right(theme_id, 1) = '5' then 'praise' else 'bug' end as kind from tm join ex using (theme_id)), v as (select *, case when kind = 'praise' then 0 else accounts end as ac, case when kind = 'praise' then 0 else greatest(mrr_weighted, 0) end as re from t), s as (select *, sqrt(ac / max(ac) over ()) as c_reach, sqrt(re / max(re) over ()) as c_revenue, greatest(0, least(1, negative_share)) as c_severity, case when mentions % 2 = 0 then least(1, log2(greatest(1 + negative_share * 2, 1)) / 2) else 0 end as c_momentum from v), z as (select *, case when kind != 'praise' then 100 * (0.25 * c_reach + 0.35 * c_revenue + 0.2 * c_severity + 0.2 * c_momentum) end as score from s), k as (select *, case when score is not null then row_number() over (order by score desc nulls last, theme_id) end as rank, case when kind != 'praise' then row_number() over (order by case when kind != 'praise' then mentions end desc nulls last, theme_id) end as vote_rank from z) select theme_id, kind, round(c_reach, 6) as c_reach, round(c_revenue, 6) as c_revenue, round(c_severity, 6) as c_severity, round(c_momentum, 6) as c_momentum, round(score, 6) as score, rank, vote_rank, vote_rank - rank as rank_shift from k",
    "release_radar": f"with e as (select min(ts)::date as lo, max(ts)::date + 1 as hi from events), rel as (select version, (lo + k::int)::date as day, theme_id, lo, hi from e, (values {', '.join(f'({v!r}, {k}, ' + (repr(x) if x else 'null') + ')' for v, k, x in RELEASES)}) as x(version, k, theme_id)), pl as (select version, day, theme_id, greatest(day - 7, coalesce(lag(day) over (order by day), day - 7), lo) as s, least(day + 7, coalesce(lead(day) over (order by day), day + 7), hi) as z from rel), tt as (select version, count(*) filter (ts::date >= s and ts::date < day) as tb, count(*) filter (ts::date >= day and ts::date < z) as ta from pl, events group by 1), c as (select version, event_type as th, count(*) filter (ts::date >= s and ts::date < day) as b, count(*) filter (ts::date >= day and ts::date < z) as a from pl, events group by 1, 2), cc as (select c.*, ta, tb from c join tt using (version)), f as (select version, {_EXPECTED} as f from cc group by 1), r as (select version, th, a, b, (a + 0.5) / (b + 0.5) / f as ratio, {_p('a', 'b', 'f')} as p from cc join f using (version) where ta > 0 and tb > 0) select pl.version, pl.day, theme_id, datediff('day', s, pl.day)::int as pre_days, datediff('day', pl.day, z)::int as post_days, b as pre_mentions, a as post_mentions, round(ratio, 6) as rate_ratio, round(p, 6) as p_value from pl left join r on r.version = pl.version and r.th = pl.theme_id",
    "theme_agreement": _AGREE + ", n as (select sum(n)::double as n, sum(n * (n - 1) / 2) as s from c), a as (select sum(m * (m - 1) / 2) as st, -sum(m / n * ln(m / n)) as ht from rt, (select n from n)), b as (select sum(m * (m - 1) / 2) as sp, -sum(m / n * ln(m / n)) as hp from cp, (select n from n)), mi as (select sum(c.n / n.n * ln(n.n * c.n / (rt.m * cp.m))) as mi from c join rt using (t) join cp using (p), n) select n::bigint as items, round((s - st * sp / (n * (n - 1) / 2)) / ((st + sp) / 2 - st * sp / (n * (n - 1) / 2)), 6) as adjusted_rand, round(mi / ((ht + hp) / 2), 6) as nmi, round(mi / ht, 6) as homogeneity, round(mi / hp, 6) as completeness from n, a, b, mi",
    "theme_recovery": _AGREE + ", mj as (select p, t as about from (select *, row_number() over (partition by p order by n desc, t) as k from c) where k = 1), x as (select c.*, about, cp.m as size, row_number() over (partition by t order by n desc, c.p) as k from c join mj using (p) join cp using (p)) select t as true_theme, sum(n)::bigint as items, round(sum(case when about = t then n else 0 end) / sum(n), 6) as recovered_share, count(*) filter (about = t) as themes, max(p) filter (k = 1) as largest_theme, round(max(n) filter (k = 1) / sum(n), 6) as largest_theme_share, round(max(n / size) filter (k = 1), 6) as largest_theme_purity from x group by t",
    "rating_scores": "with p as (select p_partkey, (p_size % 11)::double as r, p_size % 2 = 0 as survey from part) select p_partkey, case when survey or r > 5 then greatest(-1, least(1, (r - 7) / 3)) else greatest(-1, least(1, (r - 3) / 2)) end as sentiment from p",
    "folded": "select doc_id, md5(translate(lower(translate(text, 'Iİ', 'ıi')), 'çğıöşüâîû', 'cgiosuaiu')) as folded from documents",
    "accounts_joined": "select coalesce(c_mktsegment, 'unknown') as plan, count(*) as items, round(sum(coalesce(greatest(c_acctbal, 0), 0)), 2) as mrr from orders left join customer on o_custkey + 3 = c_custkey group by 1",
    "theme_centroids": "with f as (select label, unnest(range(1, len(embedding) + 1)) as k, unnest(embedding)::double as x, vec_id from embeddings), s as (select label, k, avg(x) as x, count(*) as n from f group by 1, 2), u as (select label, k, x / sqrt(sum(x * x) over (partition by label)) as x, n from s), l as (select vec_id, sqrt(sum(x * x)) as l from f group by 1), d as (select f.label, vec_id, sum(f.x * u.x) as d from f join u using (label, k) group by 1, 2) select label, (select max(n) from u where u.label = d.label) as size, round(avg(d / l), 5) as cohesion, round((select x from u where u.label = d.label and k = 1), 5) as first_component from d join l using (vec_id) group by label",
    "nearest_theme": "with f as (select label, unnest(range(1, len(embedding) + 1)) as k, unnest(embedding)::double as x, vec_id from embeddings), s as (select label, k, avg(x) as x from f group by 1, 2), u as (select label, k, x / sqrt(sum(x * x) over (partition by label)) as x from s), d as (select vec_id, u.label, sum(f.x * u.x) as d from f join u using (k) group by 1, 2), b as (select *, row_number() over (partition by vec_id order by d desc, label) as r from d) select vec_id, case when d >= 0.2 then label end as label, round(d, 5) as similarity from b where r = 1",
    "backtest": _replay_sql(_EXPECTED) + _REPLAYED,
    "backtest_by_volume": _replay_sql(_VOLUME) + _REPLAYED,
    "alert_episodes": _DAILY + ", hit as (select theme_id, day from s where n >= prior28 / 28 and n > 0), z as (select *, day - (row_number() over (partition by theme_id order by day))::int as run from hit) select theme_id, min(day) as first_day, max(day) as last_day from z group by theme_id, run",
    "alert_log": _LOG + " select * from log",
    "alert_detection": _LOG + f", det as ({_DETECTED}) select * from det",
    "alert_summary": _LOG + f", det as ({_DETECTED}), bad as (select method, theme_id, day, day - (row_number() over (partition by method, theme_id order by day))::int as run from log where not expected), runs as (select method, count(distinct (theme_id, run)) as false_alarm_episodes, count(*) as false_alarm_days from bad group by 1), found as (select method, count(days_to_detect) as spikes_detected, count(*) as spikes_total, median(days_to_detect) as median_days_to_detect from det group by 1) select method, spikes_detected, spikes_total, median_days_to_detect, coalesce(false_alarm_episodes, 0) as false_alarm_episodes, coalesce(false_alarm_days, 0) as false_alarm_days from found left join runs using (method)",
    "sentiment_quality": "with p as (select (p_size % 21 - 10) / 10.0::double as s, case p_partkey % 3 when 0 then 'negative' when 1 then 'neutral' else 'positive' end as t from part) select t as true_polarity, count(*) as items, round(avg(case t when 'positive' then (s >= 0)::int when 'negative' then (s < 0)::int end), 6) as recall, round(avg(s), 6) as mean_sentiment from p group by 1",
    "release_matching": f"with r as (select * from (values {_RELEASED}) as x(version, theme_id)), i as (select * from (values ('1.0', 'click'), ('1.1', 'click'), ('1.2', 'view'), ('1.3', 'click')) as y(version, intended_theme)), n as (select distinct event_type as t from events) select r.version, theme_id, t as matched_true_theme, intended_theme, coalesce(t = intended_theme, false) as correct from r left join i using (version) left join n on t = theme_id",
    "side_effects_checked": f"with b as (select min(ts)::date as lo from events), k as ({_KNOWN}), x as (select lo + d::int as day, theme_id from b, (values {', '.join(f'({k})' for _, k, _ in RELEASES)}) as r(d), (select distinct event_type as theme_id from events)), y as (select exists (select 1 from k where kind = 'spike' and theme = theme_id and start_date between day - 2 and day + 28) as ok from x) select count(*) as flagged, count(*) filter (ok) as real, count(*) filter (not ok) as spurious from y",
    "window_counts": f"with {M} select theme_id, count(distinct case when created_at >= '1995-01-01' and created_at < '1996-01-01' then doc end) as early, count(distinct case when created_at >= '1996-01-01' and created_at < '1997-01-01' then doc end) as late from m group by 1",
    "first_mentions": f"with {M} select doc, theme_id, position, prim as \"primary\" from m",
    "majority_theme": _AGREE + " select p, t from (select *, row_number() over (partition by p order by n desc, t) as k from c) where k = 1",
    "release_verdicts": _VERDICTS,
    "release_windows": f"with e as (select min(ts)::date as lo, max(ts)::date + 1 as hi from events), rel as (select version, lo + k::int as day, lo, hi from e, (values {', '.join(f'({v!r}, {k})' for v, k, _ in RELEASES)}) as x(version, k)) select version, greatest(day - 7, coalesce(lag(day) over (order by day), day - 7), lo) as pre_start, day as pre_end, least(day + 7, coalesce(lead(day) over (order by day), day + 7), hi) as post_end from rel",
    "sentiment": _SENTIMENT,
}
ORACLE["timeline_shares"] = f"with x as ({ORACLE['weekly']}) select week, theme_id, n, round(case when total > 0 then 100 * n / total end, 6) as percent from x"
ORACLE["score_parts"] = f"with x as ({ORACLE['priority_scores']}) select theme_id, " + ", ".join(f"round(case when score is not null then {100 * w:g} * c_{c} end, 4) as {c}" for c, w in vars(scoring.Weights()).items()) + " from x"

QUERIES = {
    f.__name__: f
    for f in (
        theme_metrics, theme_mix, weekly, daily_trailing, alert_episodes, early_warnings, false_discovery, priority_scores, release_radar, release_verdicts, theme_agreement, theme_recovery, rating_scores, folded, accounts_joined,
        theme_centroids, nearest_theme, theme_keywords, segments, redacted, sentiment, backtest, backtest_by_volume,
        alert_log, alert_detection, alert_summary, sentiment_quality, release_matching, side_effects_checked, score_parts, window_counts, first_mentions, majority_theme, timeline_shares, release_windows,
    )
}
