"""Made-up feedback with known themes, events and releases, for demonstrations and for measuring the analysis.

Two scenarios: ``team`` (English, accounts with revenue) and ``canteen`` (Turkish, users only, busy on the first
days of a month). Every draw is a hash of the seed and the row's place, so the rows are the same on any number of
partitions; the number of items of a theme and day is a Poisson draw by its inverse distribution.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, DAYS, ACCOUNTS = datetime.date(2026, 1, 5), 182, 600


@dataclass
class Dataset:
    feedback: DataFrame
    accounts: DataFrame | None
    releases: DataFrame
    ground_truth: DataFrame
    events: DataFrame
    release_truth: DataFrame

    def save(self, path: str) -> None:
        for f in fields(self):
            if (df := getattr(self, f.name)) is not None:
                df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{f.name}")

    @staticmethod
    def load(spark: SparkSession, path: str, accounts: bool = True) -> Dataset:
        read = lambda name: spark.read.options(header=True, escape='"', multiLine=True).csv(f"{path}/{name}")
        parts = {f.name: read(f.name) if f.name != "accounts" or accounts else None for f in fields(Dataset)}
        typed = {"created_at": "timestamp_ntz", "rating": "double", "mrr": "double", "multiplier": "double", "date": "date", "start_date": "date", "end_date": "date"}
        cast = lambda df: df.withColumns({c: F.col(c).cast(typed[c]) for c in df.columns if c in typed}).na.fill("", ["description"] if "description" in df.columns else [])
        return Dataset(**{name: None if df is None else cast(df) for name, df in parts.items()})


# theme, items a week, polarity, growth a week, phrases; {x} is one of WORDS["x"]
SCENARIOS = {
    "team": (
        ("login", 14, "negative", 0.0, ("I am logged out every few minutes {where}", "The sign-in page fails with an error {when}", "Login is broken {when}", "My password is refused at sign-in {where}", "Single sign-on sends me back to the login page", "Signing in takes three attempts {when}")),
        ("calendar_sync", 18, "negative", 0.0, ("Calendar sync with {calendar} is broken", "Events show up twice after the {calendar} sync", "The calendar never syncs my changes {when}", "Meetings from {calendar} arrive hours late in the calendar", "Deleted events come back with the next calendar sync", "My calendar shows the wrong time zone after syncing")),
        ("dark_mode", 10, "neutral", 0.0, ("Please add a dark mode {where}", "We need a dark theme for the evening", "Would love a dark mode option", "The bright screen hurts at night, a dark theme would help", "Is a dark mode planned {where}?")),
        ("export", 9, "neutral", 0.03, ("Please add an export to {format}", "We need to export the reports to {format}", "An {format} export of the timesheet would be great", "Let us download the report as {format}", "Exporting a board to {format} is not possible yet")),
        ("price", 11, "negative", 0.0, ("The price per seat is too expensive", "Billing went up and the plan costs too much", "Pricing is hard to justify for small teams", "The new plan price is twice what we paid", "Paying per guest seat is too expensive {when}")),
        ("onboarding", 8, "negative", 0.0, ("The setup steps are confusing for new people", "Inviting colleagues takes too many clicks", "New members get lost in the settings menu", "Nobody understands the setup wizard {where}", "It is unclear how to invite a new member")),
        ("praise", 13, "positive", 0.0, ("I love how simple it is", "Great tool, it saves us hours", "Excellent and reliable, we recommend it", "Really happy with it, great support team", "Best planning tool we ever had, we love it")),
        ("slow_app", 9, "negative", 0.0, ("The app is very slow {where}", "Loading a large board takes a minute {when}", "Scrolling the board is slow and freezes {where}", "Pages load slowly {when}", "The board hangs while loading {where}")),
        ("notifications", 9, "negative", 0.0, ("I get far too many notification emails", "Push notifications do not arrive {where}", "Notifications come twice for every comment", "I cannot mute notifications of a single project", "Mentions do not trigger a notification {when}")),
        ("search", 7, "negative", 0.0, ("Search does not find old tasks", "Searching for a task by its number gives nothing", "The search results are useless {when}", "Search ignores the comments of a task", "I never find archived tasks with the search")),
        ("recurring", 6, "neutral", 0.02, ("Please add recurring tasks", "We need tasks that repeat every month", "Repeating tasks with a due date would help", "An option to repeat a task weekly is missing", "Could recurring tasks skip holidays?")),
        ("permissions", 8, "neutral", 0.0, ("We need a read-only role for guests", "Please add permissions per project", "Guests should not see private projects", "A role that may comment but not edit is missing", "Admins need finer permissions for external guests")),
    ),
    "canteen": (
        ("card", 14, "negative", 0.0, ("Kart okutmuyor {yer}", "Kartım kasada geçmiyor", "Kart {zaman} hiç çalışmıyor", "Kartı kasada okutamadım {zaman}", "Fiziksel kart temassız geçmiyor")),
        ("balance", 12, "negative", 0.0, ("Bakiye yüklenmedi {zaman}", "Bakiyem hâlâ yansımadı", "Yükleme günü bakiye gelmedi", "Ay başı bakiyesi hesabıma yatmadı", "Bakiye eksik yüklendi {zaman}")),
        ("restaurants", 10, "neutral", 0.02, ("Daha fazla restoran eklense", "Bizim mahallede restoran olsa", "Yeni restoranlar eklenmeli", "{yer} üye restoran sayısı az", "Anlaşmalı restoran listesi genişlese")),
        ("fee", 6, "negative", 0.0, ("Komisyon ücreti çok yüksek", "Kesinti ücreti pahalı", "Aidat ücreti anlamsız", "Her yüklemede komisyon kesilmesi pahalı")),
        ("praise", 11, "positive", 0.0, ("Çok pratik ve hızlı", "Harika bir kart, memnunuz", "Kolay ve sorunsuz, teşekkürler", "Çok beğendim, herkese öneririm", "Güzel ve kullanışlı bir uygulama")),
        ("login", 8, "negative", 0.0, ("Uygulamaya giriş yapamıyorum", "Doğrulama kodu gelmiyor {zaman}", "SMS kodu gelmediği için giriş yapılamıyor", "Şifre yenileme kodu ulaşmıyor")),
        ("crash", 8, "negative", 0.0, ("Uygulama açılmıyor, sürekli kapanıyor", "Güncellemeden sonra uygulama çöküyor", "Uygulama {zaman} donuyor", "Açılış ekranında takılıp kapanıyor")),
        ("qr", 7, "negative", 0.0, ("QR kod okumuyor {yer}", "Karekod ile ödeme olmuyor", "QR ile öderken hata veriyor", "Karekod ekranı açılmıyor")),
        ("support", 7, "negative", 0.0, ("Canlı destek cevap vermiyor", "Müşteri hizmetlerine ulaşılamıyor", "Destek hattında saatlerce bekledim", "Canlı destek {zaman} yanıt yazmadı")),
        ("market", 6, "neutral", 0.02, ("Markette de geçerli olsun", "Zincir marketlerde kullanılabilse", "Market alışverişinde kullanmak istiyoruz", "Marketler de listeye eklense")),
        ("map", 5, "neutral", 0.0, ("Haritada yakındaki yerler görünsün", "Harita filtreleri eklense", "Haritada mesafeye göre sıralama olsa")),
        ("refund", 6, "negative", 0.0, ("İade hâlâ hesabıma geçmedi", "İptal edilen siparişin iadesi gelmedi", "Para iadesi {zaman} yapılmadı", "Çift çekilen tutar iade edilmedi")),
        ("campaign", 5, "neutral", 0.0, ("Daha çok kampanya olsa", "İndirim kampanyaları artmalı", "Puan kampanyası geri gelsin", "Kampanya kodu eklenebilse")),
    ),
}
WORDS = {
    "where": ("on Android", "on my iPhone", "in the browser", "on the desktop app", "in Safari"),
    "when": ("since this morning", "since the last update", "every Monday", "again", "for two weeks now"),
    "calendar": ("Outlook", "Google", "Exchange"),
    "format": ("Excel", "CSV", "PDF"),
    "yer": ("bizim semtte", "iş yerinde", "kasada", "yemekhanede"),
    "zaman": ("bu hafta", "dünden beri", "yine", "üç gündür"),
}
# theme, first day, last day, times the usual rate, days until it is reached
CHANGES = {"team": (("login", 70, 84, 5.0, 2), ("calendar_sync", 110, None, 0.3, 5)), "canteen": (("card", 80, 95, 4.0, 2), ("balance", 120, None, 0.4, 5))}
# version, day, title, theme it is about
RELEASED = {"team": (("2.1", 60, "New sign-in page", "login"), ("2.2", 108, "Rebuilt calendar sync with Outlook", "calendar_sync")), "canteen": (("3.0", 78, "Yeni kart altyapısı", "card"), ("3.1", 118, "Bakiye yükleme düzeltmesi", "balance"))}
OPENERS = {"team": ("", "", "Hi team, ", "Hello, "), "canteen": ("", "", "Merhaba, ", "Merhabalar, ")}
CLOSERS = {"team": ("", " Thanks!", " Any update on this?"), "canteen": ("", " Teşekkürler.", " Çözüm bekliyorum.")}
CHANNELS = ("app_store", "support_ticket", "nps_survey", "community")
PLANS = (("free", 0.55, 0.0), ("pro", 0.83, 120.0), ("business", 0.96, 900.0), ("enterprise", 1.0, 9000.0))


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def _pick(options: tuple, u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(u * len(options)) + 1).cast("int"))


def _poisson(rate: Column, u: Column, most: int = 200) -> Column:
    """The smallest count whose cumulated probability passes u."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.lit(0).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.when(s["sum"] > u, s).otherwise(F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), (s["k"] + 1).alias("k")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["k"])


def generate(spark: SparkSession, scenario: str = "team", seed: int = 7, days: int = DAYS, accounts: int = ACCOUNTS, scale: float = 1.0) -> Dataset:
    """The tables of a scenario; ``scale`` multiplies the number of items (a theme and day has at most 200)."""
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario!r}; there are {sorted(SCENARIOS)}")
    specs, changes = SCENARIOS[scenario], CHANGES[scenario]
    s = F.lit(seed)
    themes = spark.createDataFrame([(k, t[0], float(t[1]), t[2], float(t[3]), list(t[4])) for k, t in enumerate(specs)], "i int, theme string, weekly double, polarity string, growth double, phrases array<string>")
    cells = spark.range(days).select(F.col("id").cast("int").alias("k")).crossJoin(F.broadcast(themes))  # days x themes
    cells = cells.withColumn("day", F.date_add(F.lit(START), F.col("k")))
    rate = F.col("weekly") / 7 * scale * (1 + F.col("growth") * F.col("k") / 7) * F.when(F.dayofweek("day").isin(1, 7), 0.55).otherwise(1.12)
    if scenario == "canteen":
        rate = rate * F.when(F.dayofmonth("day") <= 3, 2.5).otherwise(1.0)
    for theme, first, last, times, ramp in changes:
        on = (F.col("theme") == theme) & (F.col("k") >= first) & (F.col("k") < (days if last is None else last))
        rate = rate * F.when(on, 1 + (times - 1) * F.least(F.lit(1.0), (F.col("k") - first + 1) / ramp)).otherwise(1.0)
    items = cells.withColumn("n", _poisson(rate, _uniform(s, "k", "i"))).filter("n > 0").withColumn("j", F.explode(F.sequence(F.lit(1), "n")))
    u = lambda what: _uniform(s, F.col("k"), F.col("i"), F.col("j"), F.lit(what))
    phrase = F.element_at("phrases", (F.floor(u("phrase") * F.size("phrases")) + 1).cast("int"))
    for slot, words in WORDS.items():
        phrase = F.replace(phrase, F.lit("{" + slot + "}"), _pick(words, u(slot)))
    stars = F.when(F.col("polarity") == "negative", 1 + F.floor(u("stars") * 2)).when(F.col("polarity") == "positive", 4 + F.floor(u("stars") * 2)).otherwise(3 + F.floor(u("stars") * 2))
    channel = _pick(CHANNELS, u("channel"))
    rating = F.when(channel == "app_store", stars).when(channel == "nps_survey", F.least(stars * 2, F.lit(10))).cast("double")
    # the square makes a few accounts loud
    who = F.format_string("A%05d", F.floor(F.pow(u("who"), F.lit(2.0)) * accounts).cast("int"))
    rows = items.select(
        F.format_string("F-%d-%d-%d", "k", "i", "j").alias("feedback_id"), (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.lit(7 * 3600) + F.floor(u("time") * 15 * 3600)).cast("decimal(18,6)"))).alias("created_at"), channel.alias("channel"), who.alias("account_id"), rating.alias("rating"),
        F.concat(_pick(OPENERS[scenario], u("open")), phrase, F.when(F.endswith(phrase, F.lit("?")), "").otherwise("."), _pick(CLOSERS[scenario], u("close"))).alias("text"), F.col("theme").alias("true_theme"), F.col("polarity").alias("true_polarity"),
    )
    date = lambda k: START + datetime.timedelta(days=k)
    known = [(t, date(a), None if b is None else date(b), times, "spike" if times > 1 else "drop") for t, a, b, times, _ in changes] + [(t[0], START, None, None, "gradual growth") for t in specs if t[3] > 0]
    held = None
    if scenario == "team":
        p = _uniform(s, F.col("id"), F.lit("plan"))
        plan, base = F.lit(PLANS[-1][0]), F.lit(PLANS[-1][2])
        for name, below, mrr in PLANS[-2::-1]:
            plan, base = F.when(p < below, name).otherwise(plan), F.when(p < below, mrr).otherwise(base)
        held = spark.range(accounts).select(F.format_string("A%05d", F.col("id").cast("int")).alias("account_id"), plan.alias("plan"), F.round(base * (0.5 + _uniform(s, F.col("id"), F.lit("mrr"))), 2).alias("mrr"))
    return Dataset(
        feedback=rows.drop("true_theme", "true_polarity"),
        accounts=held,
        releases=spark.createDataFrame([(date(k), v, title, "") for v, k, title, _ in RELEASED[scenario] if k < days], "date date, version string, title string, description string"),
        ground_truth=rows.select("feedback_id", "true_theme", "true_polarity"),
        events=spark.createDataFrame(known, "theme string, start_date date, end_date date, multiplier double, kind string"),
        release_truth=spark.createDataFrame([(v, t) for v, _, _, t in RELEASED[scenario]], "version string, intended_theme string"),
    )
