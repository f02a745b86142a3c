"""DuckDB oracle SQL for every registered query (tables are pre-registered views).

The adapters of FIXTURES.md §3 are written once here as CTE text and shared by the queries.
Doubles are rounded to 6 decimals on both sides (and negative zero normalised) so the value hash
compares the same numbers.
"""

from __future__ import annotations

from marketframe.schemas import ENGLISH_KEYWORDS, PRICE_FEATURES, TEXT_DELTA_FEATURES, TEXT_FEATURES


def R(expr: str, d: int = 6) -> str:
    return f"(CASE WHEN round({expr}, {d}) = 0 THEN 0.0 ELSE round({expr}, {d}) END)"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# --------------------------------------------------------------------------- adapters
BARS = """bars AS (
  SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         sum(o_totalprice) AS volume, arg_max(o_totalprice, o_orderkey) AS adj_close
  FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1, 2)"""

POSTS = """posts AS (
  SELECT o_orderpriority AS ticker, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS post_id,
         l_shipdate + to_hours(CAST(l_partkey % 24 AS BIGINT)) AS created_at,
         CAST(CAST(l_quantity AS INTEGER) % 3 AS BIGINT) AS likes_count,
         CAST(l_linenumber % 2 AS BIGINT) AS retweet_count, CAST(0 AS BIGINT) AS comment_count,
         l_tax * 5 AS p_negative, CAST(1.0 AS DOUBLE) - l_tax * 5 - l_discount * 5 AS p_neutral,
         l_discount * 5 AS p_positive, l_discount * 5 - l_tax * 5 AS sentiment_score,
         l_partkey, l_suppkey, l_shipdate, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

GAPPY = """gappy AS (
  SELECT b.ticker, b.date, b.open, b.high, b.low,
         CASE WHEN day(b.date) % 7 = 0 OR b.date = f.first_date THEN NULL ELSE b.close END AS close,
         b.volume, b.adj_close
  FROM bars b JOIN (SELECT ticker, min(date) AS first_date FROM bars GROUP BY ticker) f
    ON b.ticker = f.ticker)"""

RAW_TEXT = """raw_text AS (
  SELECT source AS ticker, doc_id AS post_id, lang,
    CASE WHEN doc_id % 5 = 0 THEN 'RT ' ELSE '' END || text
    || CASE WHEN doc_id % 3 = 0 THEN ' @user' || CAST(doc_id AS VARCHAR) ELSE '' END
    || CASE WHEN doc_id % 4 = 0 THEN ' http://ex.am/' || CAST(doc_id AS VARCHAR) ELSE '' END
    || CASE WHEN doc_id % 6 = 0 THEN ' #tag' || CAST(doc_id AS VARCHAR) ELSE '' END
    || CASE WHEN doc_id % 7 = 0 THEN ' 0x' || lpad(hex(doc_id), 40, 'f') ELSE '' END
    || CASE WHEN doc_id % 8 = 0 THEN ' ' || chr(128512) ELSE '' END
    || CASE WHEN doc_id % 9 = 0 THEN ' 1BoatSLRHtKNngkdXEeobR76b53LETtpyT' ELSE '' END
    || CASE WHEN doc_id % 10 = 0 THEN ' www.ex.am/' || CAST(doc_id AS VARCHAR) || '?a=b' ELSE '' END
    || CASE WHEN doc_id % 11 = 0 THEN ' 漢字かな word' ELSE '' END AS text
  FROM documents)"""

MAPPING = """mapping AS (
  SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS post_id, o_orderpriority AS ticker,
         l_partkey AS map_order
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

# --------------------------------------------------------------------------- hourly
ROLL = ("CASE WHEN isodow(created_at) >= 6 THEN CAST(CAST(created_at AS DATE) "
        "+ CAST(8 - isodow(created_at) AS INTEGER) AS TIMESTAMP) + INTERVAL 8 HOUR ELSE created_at END")


def _wmean(x: str) -> str:
    return (f"CASE WHEN sum(w) > 0 THEN sum({x} * w) / sum(w) "
            f"ELSE sum({x}) / count(*) END")


HOURLY = f"""hw_base AS (
  SELECT ticker, date_trunc('hour', {ROLL}) AS hour,
         CAST(likes_count + retweet_count AS DOUBLE) AS eng,
         ln(1 + likes_count + retweet_count) AS w,
         p_negative, p_neutral, p_positive, sentiment_score AS s
  FROM posts),
hourly AS (
  SELECT ticker, CAST(hour AS TIMESTAMP) AS hour,
         {_wmean('p_negative')} AS p_negative, {_wmean('p_neutral')} AS p_neutral,
         {_wmean('p_positive')} AS p_positive, {_wmean('s')} AS mean_sentiment,
         count(*) AS tweet_count, coalesce(stddev_samp(s), 0) AS sentiment_std,
         max(s) AS max_sentiment, min(s) AS min_sentiment,
         sum(eng) AS total_engagement, avg(eng) AS avg_engagement
  FROM hw_base GROUP BY ticker, hour)"""

HOURLY_VALUES = ["p_negative", "p_neutral", "p_positive", "mean_sentiment", "tweet_count",
                 "sentiment_std", "max_sentiment", "min_sentiment", "total_engagement",
                 "avg_engagement"]

GRID = """bounds AS (SELECT ticker, min(hour) AS first_hour, max(hour) AS last_hour
           FROM hourly GROUP BY ticker),
grid_hours AS (
  SELECT ticker, CAST(unnest(generate_series(first_hour, last_hour, INTERVAL 1 HOUR)) AS TIMESTAMP) AS hour
  FROM bounds),
grid AS (
  SELECT g.hour, g.ticker,
    coalesce(h.p_negative, 0) AS p_negative, coalesce(h.p_neutral, 0) AS p_neutral,
    coalesce(h.p_positive, 0) AS p_positive, coalesce(h.mean_sentiment, 0) AS mean_sentiment,
    coalesce(h.tweet_count, 0) AS tweet_count, coalesce(h.sentiment_std, 0) AS sentiment_std,
    coalesce(h.max_sentiment, 0) AS max_sentiment, coalesce(h.min_sentiment, 0) AS min_sentiment,
    coalesce(h.total_engagement, 0) AS total_engagement,
    coalesce(h.avg_engagement, 0) AS avg_engagement
  FROM grid_hours g LEFT JOIN hourly h ON g.ticker = h.ticker AND g.hour = h.hour)"""

DELTAS = """deltas AS (
  SELECT *,
    coalesce(mean_sentiment - lag(mean_sentiment) OVER (PARTITION BY ticker ORDER BY hour), 0)
      AS delta_mean_sentiment,
    coalesce(CAST(tweet_count - lag(tweet_count) OVER (PARTITION BY ticker ORDER BY hour) AS DOUBLE), 0)
      AS delta_tweet_count
  FROM grid)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def D(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _hourly_select(src: str, extra: list[str] | None = None) -> str:
    cols = ["hour", "ticker"] + [("tweet_count" if c == "tweet_count" else R(c) + f" AS {c}")
                                 for c in HOURLY_VALUES]
    cols += [R(c) + f" AS {c}" for c in (extra or [])]
    return f"SELECT {', '.join(cols)} FROM {src}"


# --------------------------------------------------------------------------- indicators
W = "PARTITION BY ticker ORDER BY date"


def _frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _roll(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_frame(n)} = {n} THEN {fn}({x}) OVER {_frame(n)} END"


IND = f"""ind1 AS (
  SELECT ticker, date, open, high, low, close, volume, adj_close,
    ln(1 + volume) AS log_volume,
    close / lag(close) OVER ({W}) - 1 AS return_1d,
    ln(close / lag(close) OVER ({W})) AS log_return_1d,
    close - lag(close, 10) OVER ({W}) AS momentum_10d,
    {_roll('avg', 'close', 10)} AS SMA_10,
    {_roll('avg', 'close', 20)} AS SMA_20,
    {_roll('stddev_samp', 'close', 20)} AS bb_std,
    CASE WHEN close - lag(close) OVER ({W}) > 0 THEN close - lag(close) OVER ({W}) ELSE 0 END AS gain,
    CASE WHEN close - lag(close) OVER ({W}) < 0 THEN -(close - lag(close) OVER ({W})) ELSE 0 END AS loss
  FROM bars),
ind2 AS (
  SELECT *,
    {_roll('stddev_samp', 'return_1d', 10)} AS volatility_10,
    {_roll('stddev_samp', 'return_1d', 20)} AS volatility_20,
    {_roll('avg', 'gain', 14)} AS avg_gain,
    {_roll('avg', 'loss', 14)} AS avg_loss
  FROM ind1),
ind3 AS (
  SELECT *,
    CASE WHEN avg_gain = 0 THEN 0.0 WHEN avg_loss = 0 THEN 100.0
         ELSE 100.0 - 100.0 / (1.0 + avg_gain / avg_loss) END AS RSI_14,
    SMA_20 AS BB_mid, SMA_20 + 2.0 * bb_std AS BB_upper, SMA_20 - 2.0 * bb_std AS BB_lower,
    (SMA_20 + 2.0 * bb_std) - (SMA_20 - 2.0 * bb_std) AS BB_width
  FROM ind2)"""


def _a(span):
    return 2.0 / (span + 1.0)


EMA = f"""ema_rn AS (
  SELECT ticker, date, close, row_number() OVER ({W}) - 1 AS rn FROM bars),
ema_rec AS (
  SELECT ticker, rn, date, close AS e10, close AS e12, close AS e20, close AS e26,
         CAST(0.0 AS DOUBLE) AS sig
  FROM ema_rn WHERE rn = 0
  UNION ALL
  SELECT r.ticker, r.rn, r.date,
    {D(_a(10))} * r.close + {D(1 - _a(10))} * p.e10,
    {D(_a(12))} * r.close + {D(1 - _a(12))} * p.e12,
    {D(_a(20))} * r.close + {D(1 - _a(20))} * p.e20,
    {D(_a(26))} * r.close + {D(1 - _a(26))} * p.e26,
    {D(_a(9))} * (({D(_a(12))} * r.close + {D(1 - _a(12))} * p.e12)
                 - ({D(_a(26))} * r.close + {D(1 - _a(26))} * p.e26)) + {D(1 - _a(9))} * p.sig
  FROM ema_rec p JOIN ema_rn r ON r.ticker = p.ticker AND r.rn = p.rn + 1)"""

FEAT = """feat AS (
  SELECT i.ticker, i.date, i.open, i.high, i.low, i.close, i.adj_close, i.volume, i.log_volume,
    i.return_1d, i.log_return_1d, i.momentum_10d, i.SMA_10, i.SMA_20, e.e10 AS EMA_10,
    e.e20 AS EMA_20, i.volatility_10, i.volatility_20, i.RSI_14, e.e12 - e.e26 AS MACD,
    e.sig AS MACD_signal, (e.e12 - e.e26) - e.sig AS MACD_hist,
    i.BB_mid, i.BB_upper, i.BB_lower, i.BB_width
  FROM ind3 i JOIN ema_rec e ON i.ticker = e.ticker AND i.date = e.date)"""

_FIN = " AND ".join(f"isfinite({f})" for f in PRICE_FEATURES)
ROWS = f"""prows AS (
  SELECT *, lead(close) OVER ({W}) AS next_close,
         CAST(lead(close) OVER ({W}) > close AS INTEGER) AS label,
         row_number() OVER ({W}) AS n
  FROM feat WHERE ticker IS NOT NULL AND date IS NOT NULL AND isfinite(volume) AND {_FIN}),
price_keys AS (
  SELECT ticker, date, label FROM prows WHERE n >= 60 AND next_close IS NOT NULL)"""

PRICE = [BARS, IND, EMA, FEAT, ROWS]

# --------------------------------------------------------------------------- text samples
TEXT_KEYS = f"""first_hours AS (
  SELECT ticker, min(date_trunc('hour', {ROLL})) AS first_hour FROM posts GROUP BY ticker),
labels_raw AS (
  SELECT ticker, date, close, lead(close) OVER ({W}) AS next_close FROM bars),
text_keys AS (
  SELECT l.ticker, l.date, CAST(l.next_close > l.close AS INTEGER) AS label,
         CAST(l.date AS TIMESTAMP) + INTERVAL 16 HOUR AS prediction_time
  FROM labels_raw l JOIN first_hours f ON l.ticker = f.ticker
  WHERE l.next_close IS NOT NULL
    AND CAST(l.date AS TIMESTAMP) + INTERVAL 16 HOUR - INTERVAL 72 HOUR >= f.first_hour)"""

ALIGNED = """aligned AS (
  SELECT p.date, p.ticker, p.label AS label_price, t.label AS label_text, p.label AS label
  FROM price_keys p JOIN text_keys t ON p.date = t.date AND p.ticker = t.ticker
  WHERE p.label = t.label)"""

PREDICTIONS = """predictions AS (
  SELECT date, ticker, label AS actual,
         CAST((dayofyear(date) * 37) % 101 AS DOUBLE) / CAST(101.0 AS DOUBLE) AS probability
  FROM aligned)"""

SPLIT = """split AS (
  SELECT *, row_number() OVER (ORDER BY date, ticker) AS pos, count(*) OVER () AS total
  FROM aligned),
split2 AS (
  SELECT *, CASE WHEN pos <= floor(total * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
  FROM split)"""

ALIGN_ALL = PRICE + [POSTS, TEXT_KEYS, ALIGNED]

TEXT_WIN = """tw_ex AS (
  SELECT k.ticker, k.date, k.label, g.i AS pos,
         k.prediction_time - INTERVAL 95 HOUR + to_hours(g.i) AS hour
  FROM text_keys k CROSS JOIN range(72) AS g(i)),
tw_j AS (
  SELECT e.ticker, e.date, e.label, e.pos, d.hour IS NOT NULL AS present,
    coalesce(d.p_negative, 0) + coalesce(d.p_neutral, 0) + coalesce(d.p_positive, 0)
    + coalesce(d.mean_sentiment, 0) + coalesce(CAST(d.tweet_count AS DOUBLE), 0)
    + coalesce(d.sentiment_std, 0) + coalesce(d.max_sentiment, 0) + coalesce(d.min_sentiment, 0)
    + CASE WHEN e.pos = 0 THEN 0.0 ELSE coalesce(d.delta_mean_sentiment, 0) END
    + CASE WHEN e.pos = 0 THEN 0.0 ELSE coalesce(d.delta_tweet_count, 0) END AS row_sum,
    CASE WHEN e.pos = 0 THEN 0.0 ELSE coalesce(d.delta_mean_sentiment, 0) END
    + CASE WHEN e.pos = 0 THEN 0.0 ELSE coalesce(d.delta_tweet_count, 0) END AS d_sum,
    coalesce(d.mean_sentiment, 0) AS ms,
    coalesce(d.p_negative, 0) + 2 * coalesce(d.p_neutral, 0) + 3 * coalesce(d.p_positive, 0)
    + 4 * coalesce(d.mean_sentiment, 0) + 5 * coalesce(CAST(d.tweet_count AS DOUBLE), 0)
    + 6 * coalesce(d.sentiment_std, 0) + 7 * coalesce(d.max_sentiment, 0) + 8 * coalesce(d.min_sentiment, 0)
    + CASE WHEN e.pos = 0 THEN 0.0 ELSE 9 * coalesce(d.delta_mean_sentiment, 0)
                                        + 10 * coalesce(d.delta_tweet_count, 0) END AS row_weighted
  FROM tw_ex e LEFT JOIN deltas d ON e.ticker = d.ticker AND e.hour = d.hour)"""

# --------------------------------------------------------------------------- text cleaning
WORD = r"\p{L}\p{N}_"
SPACE = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}"
EMOJI = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
         r"\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+")


def _rx(t: str, pat: str, rep: str = "") -> str:
    return f"regexp_replace({t}, '{pat}', '{rep}', 'g')"


def clean_sql(t: str = "text") -> str:
    # RE2 has no look-around: the word boundaries of the wallet patterns are matched as
    # characters and put back.
    x = _rx(t, rf"^RT[{SPACE}]+")
    x = _rx(x, rf"http[^{SPACE}]+|www\.[^{SPACE}]+")
    x = _rx(x, rf"(^|[^{WORD}])0x[a-fA-F0-9]{{40}}([^{WORD}]|$)", r"\1\2")
    x = _rx(x, rf"(^|[^{WORD}])[13][a-km-zA-HJ-NP-Z1-9]{{25,34}}([^{WORD}]|$)", r"\1\2")
    x = _rx(x, rf"@[{WORD}]+")
    x = _rx(x, rf"#[{WORD}]+")
    x = _rx(x, EMOJI)
    x = _rx(x, r"([!?.,()])", r" \1 ")
    x = f"trim({_rx(x, rf'[{SPACE}]+', ' ')})"
    return x


def tokens_sql(t: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({t}), '[^{WORD}]+'), "
            f"lambda x: regexp_full_match(x, '[a-z]+'))")


def hits_sql(toks: str, words) -> str:
    return f"len(list_filter({toks}, lambda x: list_contains({sql_list(words)}, x)))"


ENGLISH = f"""eng0 AS (
  SELECT post_id, ticker, text, {tokens_sql('text')} AS toks FROM raw_text),
eng AS (
  SELECT post_id, ticker, text, len(toks) AS n_tokens, {hits_sql('toks', ENGLISH_KEYWORDS)} AS n_hits
  FROM eng0),
eng2 AS (
  SELECT *, CASE WHEN text IS NULL OR length(text) < 3 THEN false
                 WHEN n_tokens < 5 THEN n_hits > 0
                 ELSE CAST(n_hits AS DOUBLE) / n_tokens >= CAST(0.3 AS DOUBLE) END AS is_english
  FROM eng)"""

CLEANED = f"""cl0 AS (
  SELECT post_id, ticker, is_english, CASE WHEN is_english THEN {clean_sql('text')} END AS c
  FROM eng2),
cleaned AS (
  SELECT post_id, ticker, is_english,
         CASE WHEN c IS NOT NULL AND length(c) >= 10 AND len(string_split(c, ' ')) >= 3
              THEN c END AS cleaned_text
  FROM cl0)"""


def _score_sql() -> str:
    from marketframe.operators.scoring import NEGATIVE_WORDS, NEUTRAL_LOGIT, POSITIVE_WORDS
    return f"""sc0 AS (
  SELECT post_id, cleaned_text, {tokens_sql('cleaned_text')} AS toks FROM cleaned
  WHERE cleaned_text IS NOT NULL AND length(trim(cleaned_text)) > 0),
sc1 AS (
  SELECT post_id, CAST({hits_sql('toks', NEGATIVE_WORDS)} AS DOUBLE) AS zn,
         {D(NEUTRAL_LOGIT)} AS zu, CAST({hits_sql('toks', POSITIVE_WORDS)} AS DOUBLE) AS zp
  FROM sc0),
sc2 AS (SELECT *, greatest(zn, zu, zp) AS m FROM sc1),
sc3 AS (SELECT post_id, exp(zn - m) AS en, exp(zu - m) AS eu, exp(zp - m) AS ep FROM sc2),
scored AS (
  SELECT post_id, en / (en + eu + ep) AS p_negative, eu / (en + eu + ep) AS p_neutral,
         ep / (en + eu + ep) AS p_positive FROM sc3)"""


DEDUP = """dedup AS (
  SELECT * FROM posts
  QUALIFY row_number() OVER (PARTITION BY post_id
                             ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1)"""


def _sel(src: str, cols, d: int = 6, dbl=()) -> str:
    out = [f"{R(c, d)} AS {c}" if c in dbl else c for c in cols]
    return f"SELECT {', '.join(out)} FROM {src}"


FFILL = ("coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(close IGNORE NULLS) "
         "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")

PROJ = ("CASE WHEN pc IS NULL THEN close ELSE pc * (1.0 + avg_move * abs(pp - 0.5) * 2.0 * "
        "CASE WHEN pp >= 0.5 THEN 1.0 ELSE -1.0 END) END")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["hourly_weighted"] = with_(POSTS, HOURLY) + _hourly_select("hourly")
    q["hourly_grid"] = with_(POSTS, HOURLY, GRID) + _hourly_select("grid")
    q["hourly_delta"] = (with_(POSTS, HOURLY, GRID, DELTAS)
                         + "SELECT hour, ticker, " + R("delta_mean_sentiment")
                         + " AS delta_mean_sentiment, " + R("delta_tweet_count")
                         + " AS delta_tweet_count FROM deltas")
    ind = with_(BARS, IND)
    q["returns"] = ind + _sel("ind3", ["ticker", "date", "return_1d", "log_return_1d"],
                              dbl={"return_1d", "log_return_1d"})
    q["momentum"] = ind + _sel("ind3", ["ticker", "date", "momentum_10d"], 4, {"momentum_10d"})
    q["sma"] = ind + _sel("ind3", ["ticker", "date", "SMA_10", "SMA_20"], 4, {"SMA_10", "SMA_20"})
    q["volatility"] = ind + _sel("ind3", ["ticker", "date", "volatility_10", "volatility_20"],
                                 dbl={"volatility_10", "volatility_20"})
    q["rsi"] = ind + _sel("ind3", ["ticker", "date", "RSI_14"], dbl={"RSI_14"})
    bb = ["BB_mid", "BB_upper", "BB_lower", "BB_width"]
    q["bollinger"] = ind + _sel("ind3", ["ticker", "date"] + bb, 4, set(bb))
    q["ema"] = (with_(BARS, EMA) + "SELECT ticker, date, " + ", ".join(
        f"{R('e' + str(s), 4)} AS EMA_{s}" for s in (10, 12, 20, 26)) + " FROM ema_rec")
    q["macd"] = (with_(BARS, EMA) + f"SELECT ticker, date, {R('e12 - e26', 4)} AS MACD, "
                 f"{R('sig', 4)} AS MACD_signal, {R('(e12 - e26) - sig', 4)} AS MACD_hist "
                 "FROM ema_rec")
    q["direction_label"] = with_(BARS) + f"""SELECT * FROM (
  SELECT ticker, date, {R('close', 4)} AS close, {R(f'lead(close) OVER ({W})', 4)} AS next_close,
         CAST(lead(close) OVER ({W}) > close AS INTEGER) AS label FROM bars)
WHERE next_close IS NOT NULL"""
    rowsum = " + ".join(PRICE_FEATURES)
    weighted = " + ".join(f"{i + 1} * {c}" for i, c in enumerate(PRICE_FEATURES))
    fr = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    q["price_sequences"] = with_(*PRICE) + f"""SELECT ticker, date, label, seq_len,
  {R('x_sum', 4)} AS x_sum, {R('checksum', 4)} AS checksum, {R('first_close', 4)} AS first_close, {R('close', 4)} AS last_close
FROM (
  SELECT ticker, date, label, next_close, n, close, count(*) {fr} AS seq_len,
    round(sum({rowsum}) {fr}, 1) AS x_sum,
    round(list_sum(list_transform(list({weighted}) {fr}, lambda v, i: i * v)), 1) AS checksum, first_value(close) {fr} AS first_close
  FROM prows) WHERE n >= 60 AND next_close IS NOT NULL"""
    single = " + ".join(f"{i + 1} * CAST(CAST({c} AS FLOAT) AS DOUBLE)" for i, c in enumerate(PRICE_FEATURES))
    q["sequence_store"] = with_(*PRICE) + f"""SELECT ticker, date, label,
  CASE WHEN row_number() OVER (ORDER BY date, ticker) <= floor(count(*) OVER () * CAST(0.8 AS DOUBLE))
       THEN 'train' ELSE 'test' END AS split, seq_len, true AS good, {R('checksum', 3)} AS checksum,
  {R('CAST(first_close AS DOUBLE)', 3)} AS first_close, {R('CAST(last_close AS DOUBLE)', 3)} AS last_close
FROM (
  SELECT ticker, date, label, next_close, n, count(*) {fr} AS seq_len,
    round(list_sum(list_transform(list({single}) {fr}, lambda v, i: i * v)), 0) AS checksum,
    CAST(first_value(close) {fr} AS FLOAT) AS first_close, CAST(close AS FLOAT) AS last_close
  FROM prows) WHERE n >= 60 AND next_close IS NOT NULL"""
    q["text_windows"] = with_(BARS, POSTS, HOURLY, GRID, DELTAS, TEXT_KEYS, TEXT_WIN) + f"""
SELECT ticker, date, label, CAST(sum(CAST(present AS INTEGER)) AS BIGINT) AS present_hours,
  count(*) AS n_hours, {R('sum(row_sum)')} AS x_sum, {R('sum((pos + 1) * row_weighted)')} AS checksum, {R('sum(d_sum)')} AS delta_sum,
  {R('max(CASE WHEN pos = 71 THEN ms END)')} AS last_mean_sentiment
FROM tw_j GROUP BY ticker, date, label"""
    q["align"] = with_(*ALIGN_ALL) + "SELECT date, ticker, label_price, label_text FROM aligned"
    q["chrono_split"] = (with_(*ALIGN_ALL, SPLIT)
                         + "SELECT ticker, date, split, CAST(pos AS BIGINT) AS pos FROM split2")
    q["class_balance"] = with_(*ALIGN_ALL, SPLIT) + f"""SELECT split, ticker, count(*) AS n,
  CAST(sum(label) AS BIGINT) AS n_up, {R('avg(CAST(label AS DOUBLE))')} AS up_share,
  min(date) AS first_date, max(date) AS last_date
FROM split2 GROUP BY ROLLUP (split, ticker)"""
    feats = ", ".join(PRICE_FEATURES)
    scaler = f"""psplit AS (
  SELECT ticker, date, row_number() OVER (ORDER BY date, ticker) AS pos, count(*) OVER () AS total
  FROM price_keys),
wrows AS (
  SELECT r.*, sum(CASE WHEN s.pos <= floor(s.total * CAST(0.8 AS DOUBLE)) THEN 1 ELSE 0 END)
      OVER (PARTITION BY r.ticker ORDER BY r.date ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING) AS weight
  FROM prows r LEFT JOIN psplit s ON r.ticker = s.ticker AND r.date = s.date),
wlong AS (
  UNPIVOT (SELECT ticker, date, weight, {feats} FROM wrows WHERE weight > 0)
  ON {feats} INTO NAME feature VALUE x),
means AS (
  SELECT feature, sum(x * weight) / sum(weight) AS mean, sum(weight) AS n FROM wlong GROUP BY feature),
stats AS (
  SELECT l.feature, m.mean, m.n, sum(weight * pow(x - m.mean, 2)) / sum(weight) AS var
  FROM wlong l JOIN means m ON l.feature = m.feature GROUP BY l.feature, m.mean, m.n),
stats2 AS (
  SELECT feature, mean, CASE WHEN sqrt(var) = 0 THEN 1.0 ELSE sqrt(var) END AS scale, n FROM stats)"""
    q["scaler_fit"] = with_(*PRICE, scaler) + (
        f"SELECT feature, {R('mean', 4)} AS mean, {R('scale', 4)} AS scale, "
        "CAST(n AS BIGINT) AS n FROM stats2")
    q["scaler_apply"] = with_(*PRICE, scaler) + f"""SELECT a.ticker, a.date, a.feature,
  {R('(a.x - s.mean) / s.scale')} AS value
FROM (UNPIVOT (SELECT ticker, date, {feats} FROM prows) ON {feats} INTO NAME feature VALUE x) a
JOIN stats2 s ON a.feature = s.feature"""
    q["ffill_bfill"] = with_(BARS, GAPPY) + f"SELECT ticker, date, {R(FFILL, 4)} AS close FROM gappy"
    bounds = """pb AS (
  SELECT ticker, min(created_at) AS first_post, max(created_at) AS last_post FROM posts GROUP BY ticker),
gb AS (SELECT min(first_post) AS gf, max(last_post) AS gl FROM pb)"""
    q["date_bounds"] = with_(BARS, POSTS, bounds) + f"""SELECT b.ticker, b.date, {R('b.close', 4)} AS close
FROM bars b JOIN pb ON b.ticker = pb.ticker CROSS JOIN gb
WHERE b.date >= CAST(pb.first_post AS DATE) - 100 AND b.date < CAST(pb.last_post AS DATE) + 3
  AND CAST(b.date AS TIMESTAMP) BETWEEN gb.gf - INTERVAL 90 DAY AND gb.gl"""
    q["dedup_posts"] = with_(POSTS, DEDUP) + _sel(
        "dedup", ["post_id", "ticker", "created_at", "likes_count", "retweet_count", "p_negative",
                  "p_positive", "sentiment_score"], 6, {"p_negative", "p_positive",
                                                        "sentiment_score"})
    m = """m AS (
  SELECT post_id, ticker FROM mapping WHERE ticker IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
  QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY map_order DESC, ticker DESC) = 1)"""
    q["post_ticker_join"] = with_(POSTS, DEDUP, MAPPING, m) + (
        "SELECT d.post_id, m.ticker, d.created_at FROM dedup d JOIN m ON d.post_id = m.post_id")
    q["english_filter"] = with_(RAW_TEXT, ENGLISH) + (
        "SELECT post_id, ticker, is_english, CAST(n_tokens AS BIGINT) AS n_tokens, "
        "CAST(n_hits AS BIGINT) AS n_hits FROM eng2")
    q["clean_text"] = with_(RAW_TEXT, ENGLISH, CLEANED) + (
        "SELECT post_id, ticker, cleaned_text FROM cleaned WHERE cleaned_text IS NOT NULL")
    kept = "count(*) FILTER (WHERE cleaned_text IS NOT NULL)"
    q["clean_summary"] = with_(RAW_TEXT, ENGLISH, CLEANED) + f"""SELECT ticker, count(*) AS processed,
  {kept} AS kept, count(*) FILTER (WHERE cleaned_text IS NULL) AS filtered,
  {R(f"CAST({kept} AS DOUBLE) * 100.0 / count(*)")} AS success_rate
FROM cleaned GROUP BY ticker"""
    q["sentiment_lexicon"] = with_(RAW_TEXT, ENGLISH, CLEANED, _score_sql()) + f"""SELECT post_id,
  {R('p_negative')} AS p_negative, {R('p_neutral')} AS p_neutral, {R('p_positive')} AS p_positive,
  {R('p_positive - p_negative')} AS sentiment_score FROM scored"""
    q["sentiment_buckets"] = with_(POSTS) + f"""SELECT count(*) AS n,
  {R('avg(sentiment_score)')} AS avg_polarity,
  count(*) FILTER (WHERE sentiment_score > 0.1) AS n_positive,
  count(*) FILTER (WHERE sentiment_score >= -0.1 AND sentiment_score <= 0.1) AS n_neutral,
  count(*) FILTER (WHERE sentiment_score < -0.1) AS n_negative
FROM posts"""
    preds = ALIGN_ALL + [PREDICTIONS]
    conf = """cm AS (
  SELECT count(*) FILTER (WHERE probability > 0.5 AND actual = 1) AS tp,
         count(*) FILTER (WHERE probability > 0.5 AND actual <> 1) AS fp,
         count(*) FILTER (WHERE NOT probability > 0.5 AND actual <> 1) AS tn,
         count(*) FILTER (WHERE NOT probability > 0.5 AND actual = 1) AS fn
  FROM predictions),
cm2 AS (
  SELECT *, CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS precision,
         CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS recall FROM cm)"""
    q["confusion_metrics"] = with_(*preds, conf) + f"""SELECT tp, fp, tn, fn,
  {R('CAST(tp + tn AS DOUBLE) / NULLIF(tp + fp + tn + fn, 0)')} AS accuracy,
  {R('precision')} AS precision, {R('recall')} AS recall,
  {R('CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0)')} AS specificity,
  {R('2 * precision * recall / NULLIF(precision + recall, 0)')} AS f1,
  {R('CAST(tp + fp AS DOUBLE) / NULLIF(tp + fp + tn + fn, 0)')} AS predicted_up_share
FROM cm2"""
    auc = """g AS (
  SELECT probability AS s, CAST(sum(actual) AS BIGINT) AS p, CAST(sum(1 - actual) AS BIGINT) AS n
  FROM predictions WHERE NOT isnan(probability) GROUP BY probability),
c AS (
  SELECT s, p, n,
    coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM g)"""
    q["roc_auc"] = with_(*preds, auc) + f"""SELECT
  {R('sum(p * (below + CAST(n AS DOUBLE) / 2.0)) / (CAST(sum(p) AS DOUBLE) * sum(n))')} AS roc_auc,
  CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
  (SELECT count(*) FROM predictions WHERE probability IS NULL OR isnan(probability)) AS unranked FROM c"""
    q["ticker_accuracy"] = with_(*preds) + f"""SELECT ticker, count(*) AS n,
  {R('avg(CASE WHEN CAST(probability > 0.5 AS INTEGER) = actual THEN 1.0 ELSE 0.0 END)')} AS accuracy
FROM predictions GROUP BY ticker"""
    pts = """pts AS (SELECT DISTINCT ticker, CAST(created_at AS DATE) AS query_date FROM posts)"""
    q["asof_lookup"] = with_(BARS, POSTS, pts) + f"""SELECT p.ticker, p.query_date,
  b.date AS used_date, {R('b.close', 4)} AS close
FROM pts p ASOF LEFT JOIN bars b ON p.ticker = b.ticker AND p.query_date >= b.date"""
    q["last_n"] = with_(BARS) + f"""SELECT ticker, date, {R('close', 4)} AS close,
  CAST(rank_from_end AS BIGINT) AS rank_from_end FROM (
  SELECT ticker, date, close,
    row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rank_from_end
  FROM bars WHERE date <= DATE '2000-06-30') WHERE rank_from_end <= 30"""
    q["sample_k"] = with_(POSTS, DEDUP) + """SELECT ticker, post_id, created_at,
  CAST(rk AS BIGINT) AS rank FROM (
  SELECT ticker, post_id, created_at,
    row_number() OVER (PARTITION BY ticker ORDER BY post_id) AS rk
  FROM dedup) WHERE rk <= 200"""
    q["price_join"] = with_(*preds) + f"""SELECT p.date, p.ticker, p.actual,
  {R('p.probability', 4)} AS probability, {R('b.close', 4)} AS close
FROM predictions p JOIN bars b ON p.ticker = b.ticker AND p.date = b.date"""
    proj = f"""recent AS (
  SELECT * FROM predictions
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 30),
enough AS (SELECT * FROM recent QUALIFY count(*) OVER (PARTITION BY ticker) >= 5),
hist AS (
  SELECT p.ticker, p.date, p.probability, b.close
  FROM enough p JOIN bars b ON p.ticker = b.ticker AND p.date = b.date
  QUALIFY count(*) OVER (PARTITION BY p.ticker) >= 5),
pj AS (
  SELECT *, lag(close) OVER ({W}) AS pc, lag(probability) OVER ({W}) AS pp FROM hist),
pj2 AS (
  SELECT *, avg(abs(close / pc - 1)) OVER (PARTITION BY ticker) AS mv FROM pj),
pj3 AS (SELECT *, CASE WHEN mv > 0 THEN mv ELSE 0.01 END AS avg_move FROM pj2)"""
    q["projection"] = with_(*preds, proj) + f"""SELECT ticker, date, {R('close', 4)} AS close,
  {R(PROJ, 4)} AS predicted_close, {R('avg_move', 4)} AS avg_move FROM pj3"""
    q["day_change"] = with_(BARS) + f"""SELECT ticker, date,
  {R('CASE WHEN open <> 0 THEN (close - open) / open * 100 ELSE 0.0 END')} AS day_change_pct
FROM bars"""
    q["signal"] = with_(*preds) + f"""SELECT ticker, date, {R('probability')} AS probability,
  CASE WHEN probability >= 0.5 THEN 'Up' ELSE 'Down' END AS trend,
  {R('greatest(probability, 1.0 - probability)')} AS confidence FROM predictions"""
    q["table_stats"] = with_(POSTS) + """SELECT ticker, count(*) AS n_rows,
  min(created_at) AS first_ts, max(created_at) AS last_ts,
  first(post_id ORDER BY created_at, post_id) AS first_id,
  last(post_id ORDER BY created_at, post_id) AS last_id
FROM posts GROUP BY ticker"""
    # the fixture adds one entity; html.unescape leaves other texts as they are
    q["html_decode"] = with_(RAW_TEXT) + """SELECT post_id,
  CASE WHEN post_id % 2 = 0 THEN text || ' & co' ELSE text END AS decoded FROM raw_text"""
    q["ingest_posts"] = """WITH li AS (
  SELECT *, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_partkey % 5 <> 0),
p AS (
  SELECT * FROM li QUALIFY row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, day) = 1),
m AS (
  SELECT l_orderkey, max(l_linenumber) AS last FROM lineitem WHERE l_orderkey % 9 <> 0 GROUP BY 1)
SELECT CAST(p.l_orderkey AS VARCHAR) AS post_id, ['AAPL', 'GOOG', 'TSLA'][1 + CAST(m.last % 3 AS INTEGER)] AS ticker,
  'say "' || l_partkey || '"' || chr(10) || 'line, ' || l_suppkey AS text,
  'writer' || (l_suppkey % 50) AS author,
  CAST(day AS TIMESTAMP) + to_seconds(l_linenumber * 61) AS created_at,
  CAST(l_suppkey % 7 AS BIGINT) AS likes_count, CAST(l_partkey % 3 AS BIGINT) AS retweet_count,
  CAST(l_partkey % 4 AS BIGINT) AS comment_count
FROM p JOIN m ON p.l_orderkey = m.l_orderkey"""
    q["read_bars"] = f"""SELECT o_orderpriority || '-' || o_orderkey AS ticker,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
  {R('o_totalprice', 4)} AS open, {R('o_totalprice', 4)} AS high,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {R('o_totalprice', 4)} END AS low, {R('o_totalprice', 4)} AS close,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS volume,
  {R('o_totalprice', 4)} AS adj_close FROM orders"""
    q["sequence_inference"] = with_(*PRICE, scaler) + """, z AS (
  SELECT a.ticker, a.date, avg((a.x - s.mean) / s.scale) AS m
  FROM (UNPIVOT (SELECT ticker, date, return_1d, momentum_10d FROM prows)
        ON return_1d, momentum_10d INTO NAME feature VALUE x) a
  JOIN stats2 s ON a.feature = s.feature GROUP BY a.ticker, a.date)
SELECT k.ticker, k.date, k.label, round(1 / (1 + exp(-z.m)), 4) AS probability
FROM price_keys k JOIN z ON k.ticker = z.ticker AND k.date = z.date"""
    thin = f"""thin AS (
  SELECT ticker, date, close, lead(close) OVER ({W}) AS next_close FROM bars WHERE day(date) % 11 <> 0),
disagree AS (
  SELECT p.date, p.ticker, CAST(p.next_close > p.close AS INTEGER) AS label_price, t.label AS label_text
  FROM thin p JOIN text_keys t ON p.date = t.date AND p.ticker = t.ticker WHERE p.next_close IS NOT NULL)"""
    q["agreement_report"] = with_(BARS, POSTS, TEXT_KEYS, thin) + f"""SELECT count(*) AS aligned,
  CAST(sum(CAST(label_price = label_text AS INTEGER)) AS BIGINT) AS agreeing,
  {R('avg(CAST(label_price = label_text AS INTEGER))')} AS agreement FROM disagree"""
    q["keep_agreeing"] = with_(BARS, POSTS, TEXT_KEYS, thin) + """SELECT date, ticker, label_price, label_text,
  label_price AS label FROM disagree WHERE label_price = label_text"""
    q["hour_reindex"] = with_(POSTS, HOURLY) + """, b AS (
  SELECT ticker, min(hour) - INTERVAL 24 HOUR AS lo, min(hour) + INTERVAL 240 HOUR AS hi FROM hourly GROUP BY ticker),
g AS (SELECT ticker, CAST(unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS TIMESTAMP) AS hour FROM b)
SELECT g.hour, g.ticker, """ + ", ".join(
        ("coalesce(tweet_count, 0)" if c == "tweet_count" else R(f"coalesce({c}, 0)")) + f" AS {c}" for c in HOURLY_VALUES) \
        + " FROM g LEFT JOIN hourly h ON g.ticker = h.ticker AND g.hour = h.hour"
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ("open", "high", "low", "close", "volume", "adj_close"))
    q["null_report"] = with_(BARS, GAPPY) + f"""SELECT 'before' AS stage, CAST({nulls} AS BIGINT) AS nulls FROM gappy
UNION ALL SELECT 'after', count(*) FILTER (WHERE c IS NULL) FROM (SELECT {FFILL} AS c FROM gappy)"""
    q["preview"] = with_(BARS) + f"SELECT ticker, date, {R('close', 4)} AS close FROM bars ORDER BY ticker, date LIMIT 5"
    q["extra_indicator"] = with_(BARS) + f"""SELECT ticker, date, {R('max(close) OVER f - min(close) OVER f', 4)} AS range_5
FROM bars WINDOW f AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
    q["scaler_store"] = with_(*PRICE, scaler) + (
        f"SELECT feature, {R('mean', 4)} AS mean, {R('scale', 4)} AS scale FROM stats2")
    q["predictions_export"] = with_(*preds) + f"""SELECT date, ticker, actual,
  CAST(probability > 0.5 AS INTEGER) AS predicted, {R('probability')} AS probability FROM predictions"""
    q["date_text"] = with_(BARS) + """SELECT ticker, strftime(date, '%d/%m/%Y') AS text, date AS parsed,
  CAST(NULL AS DATE) AS unreadable FROM bars"""
    q["logit_probabilities"] = with_(BARS) + f"""SELECT ticker, date,
  {R('1 / (1 + exp(-10 * (close - open) / open))')} AS probability FROM bars"""
    q["sentiment_model"] = q["sentiment_lexicon"]
    q["append_posts"] = with_(POSTS) + f"""SELECT post_id, ticker, created_at, likes_count, {R('p_positive')} AS p_positive
FROM posts QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY l_partkey % 2,
                                      l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1"""
    q["replace_tickers"] = with_(BARS) + f"""SELECT ticker, date, {R("close * CASE WHEN ticker = '1-URGENT' THEN 2 ELSE 1 END", 4)} AS close
FROM bars WHERE ticker <> '2-HIGH' AND (ticker <> '1-URGENT' OR day(date) % 2 = 0)"""
    from marketframe.plans.catalog import fusion_weight
    weight = ", ".join(f"('{f}', {D(fusion_weight(i))})" for i, f in enumerate(PRICE_FEATURES))
    hour = " + ".join(f"{D(fusion_weight(i))} * coalesce(d.{f}, 0)" for i, f in enumerate(TEXT_FEATURES))
    delta = " + ".join(f"{D(fusion_weight(len(TEXT_FEATURES) + i))} * coalesce(d.{f}, 0)"
                       for i, f in enumerate(TEXT_DELTA_FEATURES))
    q["fused_inference"] = with_(*PRICE, scaler, POSTS, HOURLY, GRID, DELTAS, TEXT_KEYS) + f""", pw AS (
  SELECT a.ticker, a.date, sum(w.weight * (a.x - s.mean) / s.scale) AS r
  FROM (UNPIVOT (SELECT ticker, date, {feats} FROM prows) ON {feats} INTO NAME feature VALUE x) a
  JOIN stats2 s ON a.feature = s.feature JOIN (VALUES {weight}) w(feature, weight) ON a.feature = w.feature
  GROUP BY a.ticker, a.date),
pz AS (SELECT ticker, date, avg(r) {fr} AS z FROM pw),
px AS (SELECT k.ticker, k.date, pz.z FROM price_keys k JOIN pz ON k.ticker = pz.ticker AND k.date = pz.date),
tx AS (
  SELECT k.ticker, k.date, k.label, sum({hour} + CASE WHEN g.i = 0 THEN 0.0 ELSE {delta} END) / 72 AS z
  FROM text_keys k CROSS JOIN range(72) AS g(i)
  LEFT JOIN deltas d ON k.ticker = d.ticker AND d.hour = k.prediction_time - INTERVAL 95 HOUR + to_hours(g.i)
  GROUP BY k.ticker, k.date, k.label)
SELECT t.ticker, t.date, t.label, p.z IS NOT NULL AS has_price,
       round(1 / (1 + exp(-(t.z + coalesce(p.z, 0)))), 4) AS probability
FROM tx t LEFT JOIN px p ON t.ticker = p.ticker AND t.date = p.date"""
    return q
