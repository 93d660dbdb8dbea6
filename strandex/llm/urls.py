"""URL filter: allow and block rules first, then a logistic regression on hashed character n-grams of host and path.

The regression is fitted on the driver from a small labelled table of URLs (at most MAX_LABELLED rows are read, a documented bound); its
weights are one array of 2**BITS floats, a proven size. Scoring hashes all n-grams of a batch at once with NumPy, within the task that
read the urls: no shuffle.

Defined cases: a null url, or one without "://", has an empty host and path and is judged by the model's intercept; repeated rows are
judged alike; further columns are ignored; an empty table gives no rows; without labelled urls every url that no rule fits is allowed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.llm.common import powers, prefix_hash, substring_hash, table, texts_of, tidy

#: (verdict, rule): a host, with its subdomains, and the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: A small labelled table, host and path: to block. Names that sell, lure or spread links, written by hand without a look at any table under test.
TO_BLOCK = """
discount-rx-tablets.shop/buy-now/12 diet-pills-outlet.biz/order generic-meds-express.pharmacy/cart cheap-viagra-store.com/en/offer/9 www.buy-cialis-online.net/fr/7
online-casino-jackpot.com/de/spin/3 best-poker-bonus.org/join/15 free-slots-casino.club/en/22 www.lucky-roulette-win.casino/de/signup sports-betting-tips.bet/vip
hot-singles-tonight.date/join adult-cam-chat.live/en/rooms xxx-tube-videos.porn/watch/9 sexy-dating-now.click/es/register www.escort-girls-city.xxx/list
fast-payday-loans.loan/apply easy-cash-money.net/en/today/6 bad-credit-loans.org/quick/81 www.make-money-fast.online/secret work-from-home-rich.info/start
replica-watches-outlet.org/en/sale/207 fake-designer-bags.shop/en/cheap www.cheap-handbags-sale.com/buy wholesale-sneakers-discount.top/de/4 luxury-replicas.cheap/fr/11
free-iphone-winner.click/claim you-won-a-prize.xyz/en/redeem gift-card-generator.net/free/44 www.claim-your-reward.com/fr/survey lottery-winner-notice.info/pay
crypto-doubler.top/invest bitcoin-profit-bot.biz/en/signup www.instant-forex-profit.trade/join guaranteed-returns-invest.money/now double-your-coins.click/es/2
download-crack-keygen.xyz/setup.exe free-warez-serials.top/en/get www.movie-torrent-free.download/hd nulled-scripts-cracked.info/file software-activator-free.site/dl
buy-backlinks-cheap.org/en/packages/5 www.link-farm-directory.net/de/add seo-spam-network.biz/en/rank article-spinner-links.xyz/post auto-blog-content.click/spam
click-here-ads.click/banner www.popup-traffic-exchange.top/hits cheap-web-traffic.net/en/buy/310 get-followers-fast.com/likes/12 buy-fake-reviews.online/order
secure-login-verify-account.xyz/signin update-your-bank-info.top/login www.account-suspended-alert.click/verify paypa1-security-check.info/en/confirm webmail-quota-upgrade.site/auth
""".split()
#: And to allow: well known places, and names of the same kind.
TO_ALLOW = """
en.wikipedia.org/wiki/Photosynthesis de.wikipedia.org/wiki/Bibliothek fr.wikipedia.org/wiki/Histoire es.wikipedia.org/wiki/Historia www.wikidata.org/wiki/Q42
docs.python.org/3/library/json.html developer.mozilla.org/en-US/docs/Web spark.apache.org/docs/latest/ www.postgresql.org/docs/current/ kernel.org/doc/html/latest
github.com/apache/spark stackoverflow.com/questions/11227809 arxiv.org/abs/1706.03762 www.nature.com/articles/s41586 pubmed.ncbi.nlm.nih.gov/31452104
www.bbc.co.uk/news/science www.theguardian.com/world www.lemonde.fr/sciences elpais.com/cultura www.spiegel.de/wissenschaft
www.gov.uk/browse/education europa.eu/youreurope/citizens www.bundestag.de/parlament www.service-public.fr/particuliers www.nasa.gov/missions
www.stadtbibliothek-koeln.de/angebote www.britishmuseum.org/collection www.louvre.fr/en/explore www.museodelprado.es/coleccion library.harvard.edu/services
www.mit.edu/research ocw.mit.edu/courses/mathematics www.uni-heidelberg.de/de/studium www.sorbonne-universite.fr/recherche www.uam.es/estudios
weather.gov/forecast www.meteofrance.com/previsions www.dwd.de/wetter openstreetmap.org/relation/62422 gutenberg.org/ebooks/1342
blog.golang.org/slices www.gardenersworld.com/how-to/grow-plants cooking.nytimes.com/recipes/1019 m.allrecipes.com/recipe/20144 travel.state.gov/content
wiki.archlinux.org/title/Installation forum.gardening-club.org/topic/31 history.town-archive.net/maps school-district.k12.us/calendar community.choir-society.org/concerts
www.red-cross.org/first-aid parks.city-council.org/trails news.university-press.net/2020/05 open-data.region-authority.eu/sets science.teachers-network.org/lessons
www.garden-center.com/en/plants/120 city-news.net/de/sport/12 m.weather-service.net/fr/today/8.html blog.mountain-hiking.com/es/rutas/77 www.furniture-maker.net/en/tables/340
river-museum.net/en/visit train-timetable.com/de/plan/55 www.bakery-school.com/fr/cours/9 m.local-radio.net/es/programa/310 blog.astronomy-notes.net/en/moon/600/
translation-office.com/de/team/1 www.hospital-north.net/en/doctors/84 theatre-season.com/fr/2024/3 bird-watching.net/es/aves/450 www.chess-league.com/en/table/29
blog.math-puzzles.net/de/raetsel/710 m.recipes-from-home.com/en/soup/93.html www.river-transport.net/fr/horaires/18 village-history.com/en/church/205 www.language-course.net/es/nivel/64
""".split()
LABELLED_URLS = (*((u, 1) for u in TO_BLOCK), *((u, 0) for u in TO_ALLOW))
MAX_LABELLED, BITS, SIZES = 100_000, 14, (3, 4, 5)
#: A url is blocked from this probability on.
BLOCK_FROM = 0.5


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grams(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct character n-gram of ^text$, over the bytes of UTF-8."""
    data, off = texts_of(column)
    n = len(off) - 1
    size = np.diff(off) + 2
    starts = np.concatenate([[0], np.cumsum(size)])
    marked = np.empty(starts[-1], np.uint8)
    marked[starts[:-1]], marked[starts[1:] - 1] = 94, 36
    row = np.repeat(np.arange(n), np.diff(off))
    marked[np.arange(len(data)) + 2 * row + 1] = data
    row_of, last = np.repeat(np.arange(n), size), np.repeat(starts[1:], size)
    h, at = prefix_hash(marked), np.arange(len(marked))
    rows, buckets = [], []
    for k in SIZES:
        ok = np.flatnonzero(at + k <= last)
        rows.append(row_of[ok])
        buckets.append((substring_hash(h, ok, ok + k) >> np.uint64(64 - bits)).astype(np.int64))
    pair = np.unique(np.concatenate(rows) * (1 << bits) + np.concatenate(buckets)) if n else np.zeros(0, np.int64)
    return pair >> bits, pair & ((1 << bits) - 1)


class UrlModel:
    """Logistic regression over hashed n-grams; each url's features are scaled to unit length."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], epochs: int = 400, rate: float = 4.0, decay: float = 1e-4) -> UrlModel:
        w, b, n = np.zeros(1 << BITS), 0.0, len(texts)
        if not n:
            return cls(w, b)
        rows, buckets = grams(pa.array(texts, pa.string()))
        y = np.asarray(labels, float)
        x = 1 / np.sqrt(np.bincount(rows, minlength=n))[rows]
        for _ in range(epochs):
            p = 1 / (1 + np.exp(-(np.bincount(rows, w[buckets] * x, n) + b)))
            g = (p - y) / n
            w -= rate * (np.bincount(buckets, g[rows] * x, len(w)) + decay * w)
            b -= rate * g.sum()
        return cls(w, b)

    def blocked(self, column: pa.Array) -> np.ndarray:
        rows, buckets = grams(column)
        n = len(column)
        scale = np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
        return np.bincount(rows, self.weights[buckets], n) / scale + self.bias > np.log(BLOCK_FROM / (1 - BLOCK_FROM))


def site(text: str) -> str:
    """The last two names of a host and path's host: what belongs together when labelled rows are split."""
    return ".".join(text.split("/", 1)[0].split(".")[-2:])


def held_out(labelled: list[tuple[str, int]], folds: int = 5) -> dict[str, float]:
    """Precision and recall of blocking, each row judged by a model that saw no row of its site."""
    fold = [zlib.crc32(site(t).encode()) % folds for t, _ in labelled]
    hit = said = real = 0
    for k in range(folds):
        own = [x for x, f in zip(labelled, fold, strict=True) if f == k]
        rest = [x for x, f in zip(labelled, fold, strict=True) if f != k]
        if own:
            guess = UrlModel.fit([t for t, _ in rest], [y for _, y in rest]).blocked(pa.array([t for t, _ in own], pa.string()))
            y = np.array([y for _, y in own]) == 1
            hit, said, real = hit + int((guess & y).sum()), said + int(guess.sum()), real + int(y.sum())
    return {"precision": hit / max(1, said), "recall": hit / max(1, real)}


def labelled_rows(labelled: DataFrame, url: str = "url", label: str = "label") -> list[tuple[str, int]]:
    """(host and path, label) of a table of labelled urls (1 to block, 0 to allow, others ignored), each url with its highest label; of more than
    MAX_LABELLED those with the least hashes."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.concat(host_of(F.col(url)), path_of(F.col(url))).alias("t"), F.col(label).cast("int").alias("y")).where("t <> ''")
    return [(r.t, r.y) for r in rows.groupBy("t").agg(F.max("y").alias("y")).orderBy(F.xxhash64("t"), "t").limit(MAX_LABELLED).collect()]


def filter_urls(pages: DataFrame, labelled: list[tuple[str, int]] | DataFrame, rules=RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep, host, path, rule, verdict of every row of pages. labelled: a table with url and label, or a short list of (host and path, label)."""
    labelled = labelled_rows(labelled) if isinstance(labelled, DataFrame) else labelled[:MAX_LABELLED]
    model = UrlModel.fit([t for t, _ in labelled], [y for _, y in labelled])
    found = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = found.select(*keep, "host", "path", rule.alias("rule"), verdict.alias("verdict"))

    def judge(batches):
        powers(1 << 12)
        for batch in batches:
            names = batch.schema.names
            said = batch.column(names.index("verdict")).to_pylist()
            texts = pa.array([h + p for h, p in zip(batch.column(names.index("host")).to_pylist(), batch.column(names.index("path")).to_pylist(), strict=True)], pa.string())
            blocked = model.blocked(texts)
            said = [v or ("block" if x else "allow") for v, x in zip(said, blocked, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said, pa.string())], names=names)

    return found.mapInArrow(tidy(judge), found.schema)


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), list(LABELLED_URLS))



def url_rules(spark, sf_dir: str) -> DataFrame:
    """What op10's rules alone say of each url."""
    found = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return found.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))


#: Of url_rules; the verdict on other urls is learned.
SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules AS (SELECT unnest(['com/', 'example.com/en/', 'www.example.com/en/', 'net/es/', 'net/fr/']) AS rule, unnest(['allow', 'block', 'allow', 'block', 'block']) AS said),
fit AS (SELECT page_id, rule, said FROM p, rules WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, rule[instr(rule, '/'):]) QUALIFY row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC) = 1)
SELECT page_id, host, path, rule, said AS by_rule FROM p LEFT JOIN fit USING (page_id)
"""
