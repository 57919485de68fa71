"""Language identification by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm.base import slices, unused, utf8
from tallyspark.session import stored

BUCKETS = 32_768  # hashed letter trigrams
OVERLAPPING = 3.0  # neighbouring trigrams share letters: a trigram counts a third
LEAST_SHARE = 0.001  # of the declared rows, for a declared value that is no language code to be modelled
AT_ONCE = 64  # languages whose counts the driver takes in together
UNKNOWN, UNKNOWN_PRIOR = "und", 0.01
SMOOTHING = 20.0  # rows of the level above that a host, a domain or the whole counts as
LEAST_POSTERIOR = 0.5

# two letters (ISO 639-1), then three letters (ISO 639-2 and others that web pages declare)
LANGUAGE_CODES = frozenset(
    """
    aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo
    es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg
    ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn
    no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg sh si sk sl sm sn so sq sr ss st su sv sw
    ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu
    aar abk ace ach ada ady afr ain aka akk alb ale alt amh ang anp ara arc arg arm arn arp arw asm ast ava ave awa
    aym aze bak bal bam ban baq bas bej bel bem ben bho bik bin bis bla bod bos bra bre bua bug bul bur byn cad car cat
    ceb ces cha chb che chg chi chk chm chn cho chp chr chu chv chy ckb cnr cop cor cos cre crh csb cym cze dak dan dar
    del den deu dgr din div doi dsb dua dum dut dyu dzo efi egy eka ell elx eng enm epo est eus ewe ewo fan fao fas fat
    fij fil fin fon fra fre frm fro frr frs fry ful fur gaa gay gba geo ger gez gil gla gle glg glv gmh goh gon gor got
    grb grc gre grn gsw guj gwi hai hat hau haw heb her hil hin hit hmn hmo hrv hsb hun hup hye iba ibo ice ido iii iku
    ile ilo ina ind inh ipk isl ita jav jbo jpn jpr jrb kaa kab kac kal kam kan kas kat kau kaw kaz kbd kha khm kho kik
    kin kir kmb kok kom kon kor kos kpe krc krl kru kua kum kur kut lad lah lam lao lat lav lez lim lin lit lol loz ltz
    lua lub lug lui lun luo lus mac mad mag mah mai mak mal man mao mar mas may mdf mdr men mga mic min mkd mlg mlt mnc
    mni moh mon mos mri msa mus mwl mwr mya myv nap nau nav nbl nde ndo nds nep new nia niu nld nno nob nog non nor
    nqo nso nwc nya nym nyn nyo nzi oci oji ori orm osa oss ota pag pal pam pan pap pau peo per phn pli pol pon por pro
    pus que raj rap rar roh rom ron rum run rup rus sad sag sah sam san sas sat scn sco sel sga shn sid sin slk slo slv
    sma sme smj smn smo sms sna snd snk sog som sot spa sqi srd srn srp srr ssw suk sun sus sux swa swe syc syr tah tam
    tat tel tem ter tet tgk tgl tha tib tig tir tiv tkl tlh tli tmh tog ton tpi tsi tsn tso tuk tum tur tvl twi tyv udm
    uga uig ukr umb urd uzb vai ven vie vol vot wal war was wel wln wol xal xho yao yap yid yor yue zap zbl zen zgh zha
    zho zul zun zza als ami arb ary arz atj avk
    azb azj bar bcl bjn blk bpy bxr cbk cdo cmn cnh dag diq dty ekk eml ext frp fuv gag gaz gcr glk gom gpe gur guw
    hak hif hyw ixl jam kbp kcg kek khk kmr koi ksh lbe lfn lij lld lmo ltg lvs lzh mam mhr mnw mrj mzn nan nov npi
    olo ory pbt pcd pcm pdc pes pfl pih plt pms pnb pnt prs pwn quc quy quz rmy rsk rue sgs skr stq swh szl szy tay
    tcy tly trv uzn vec vep vls vro wuu xmf ydd yue zea zgh zlm zsm
    """.split()
)

NOT_LETTERS = bytes(range(65)) + bytes(range(91, 97)) + bytes(range(123, 128))
LETTERS = bytes.maketrans(NOT_LETTERS, b" " * len(NOT_LETTERS))


def trigrams(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased words; digits, marks and white space are one blank."""
    codes = np.frombuffer(b" " + text.translate(LETTERS).lower() + b" ", dtype=np.uint8)
    blank = codes == 32
    codes = codes[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)
    if len(codes) < 3:
        return np.empty(0, dtype=np.uint32)
    mixed = (codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1]) * np.uint32(0x85EBCA6B) + codes[2:]
    return (mixed * np.uint32(0xC2B2AE35)) >> np.uint32(17)


def modelled_languages(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` with its declared values settled, and the languages that are modelled, in alphabetical order.

    Every declared language code is modelled, however few rows have it. Any other value is modelled if it has a share
    of the declared rows, so there are a thousand of them at most; below that, a code with a region or script
    (``zu-za``) counts as the code, and other values stay as evidence only.
    """
    counts = stored(rows.where("declared IS NOT NULL").groupBy("declared").count(), "declared_counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    is_code = lambda c: c.isin(*sorted(LANGUAGE_CODES))
    frequent = counts.where(~is_code(F.col("declared")) & (F.col("count") >= LEAST_SHARE * total))
    frequent = [r.declared for r in frequent.select("declared").collect()]
    base = F.regexp_extract("declared", r"^([a-z]{2,3})[-_]", 1)
    settled = F.when(is_code(base) & ~F.col("declared").isin(frequent), base).otherwise(F.col("declared"))
    codes = counts.select(settled.alias("code")).where(is_code(F.col("code"))).distinct().collect()
    return rows.withColumn("declared", settled), sorted({*frequent, *(r.code for r in codes)})


def trigram_tables(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probabilities of the buckets by language, from all rows; the last line is the unknown language."""
    place = {language: k for k, language in enumerate(languages)}

    def count(batches):
        counts = {}
        for batch in slices(batches):
            of = {}
            for text, declared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of.setdefault(declared, []).append(trigrams(text))
            for declared, found in of.items():
                sums = counts.setdefault(declared, np.zeros(BUCKETS, dtype=np.int64))
                for one in found:
                    sums += np.bincount(one, minlength=BUCKETS) if len(one) > BUCKETS else 0
                short = [one for one in found if len(one) <= BUCKETS]
                if short:
                    sums += np.bincount(np.concatenate(short), minlength=BUCKETS)
        for declared, sums in counts.items():
            bucket = np.flatnonzero(sums)
            language = pa.array(np.full(len(bucket), place[declared]), pa.int64())
            columns = [language, pa.array(bucket, pa.int64()), pa.array(sums[bucket], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["language", "bucket", "n"])

    tables = np.full((len(languages) + 1, BUCKETS), -np.log(BUCKETS), dtype=np.float32)
    if languages:
        seen = rows.where(F.col("declared").isin(languages)).select("text", "declared")
        sums = seen.mapInArrow(count, "language long, bucket long, n long")
        sums = sums.groupBy("language", "bucket").agg(F.sum("n").alias("n"))
        if len(languages) > AT_ONCE:
            sums = stored(sums, "trigrams")
        for first in range(0, len(languages), AT_ONCE):
            some = min(AT_ONCE, len(languages) - first)
            found = sums.where(F.col("language").between(first, first + some - 1)).toPandas().to_numpy()
            counts = np.full((some, BUCKETS), 0.5)
            counts[found[:, 0] - first, found[:, 1]] += found[:, 2]
            tables[first : first + some] = np.log(counts / counts.sum(axis=1, keepdims=True))
    return tables


def text_evidence(rows: DataFrame, tables: np.ndarray) -> DataFrame:
    """``rows`` without their texts but with ``likelihood``, an array of log likelihoods, and ``grams``."""
    sent = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(tables.T, dtype=np.float32))

    def score(batches):
        by_bucket = sent.value
        step = min(65536, max(1024, (1 << 22) // by_bucket.shape[1]))
        for batch in slices(batches):
            likelihood, grams = [], []
            for text in batch.column("text").to_pylist():
                found = trigrams(text)
                grams.append(len(found))
                # in parts, so that a long text needs bounded memory
                parts = [by_bucket[found[k : k + step]].sum(axis=0, dtype=np.float64) for k in range(0, len(found), step)]
                likelihood.append((sum(parts) / OVERLAPPING).tolist() if parts else [0.0] * by_bucket.shape[1])
            batch = batch.drop_columns(["text"])
            batch = batch.append_column("likelihood", pa.array(likelihood, pa.list_(pa.float64())))
            yield batch.append_column("grams", pa.array(grams, pa.int64()))

    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(score, f"{schema}, likelihood array<double>, grams long")


def level(rows: DataFrame, key: str, name: str, size: int) -> DataFrame:
    """Rows of each text guess by ``key``, as an array in ``name``; null keys have none."""
    counts = [F.count_if(F.col("guess") == k).cast("double") for k in range(size)]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*counts).alias(name))


def smoothed(counts: Column, above: Column) -> Column:
    """Shares of ``counts`` with ``SMOOTHING`` rows of the level above; without counts the level above."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, n: s + n) + SMOOTHING
    return F.coalesce(F.zip_with(counts, above, lambda n, p: (n + p * SMOOTHING) / total), above)


def conditional(rows: DataFrame, column: str, size: int) -> DataFrame:
    """``log P(column | language)`` by value of ``column``: an array, from the text guesses of all rows."""
    found = level(rows, column, "n", size)
    kinds = found.count() + 1
    totals = found.agg(*(F.sum(F.col("n")[k]) for k in range(size))).first()
    odds = [F.log((F.col("n")[k] + 1.0) / ((totals[k] or 0.0) + kinds)) for k in range(size)]
    return found.select(column, F.array(*odds).alias(f"by_{column}"))


def identify(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, ``language``, ``posterior`` and ``accepted`` for every row.

    ``rows`` has ``text``, ``declared``, ``suffix``, ``domain`` and ``host`` strings besides the ``keep`` columns.
    Trigram counts by declared language, over all rows, make the text likelihoods; a language that one row declares
    is a known language, whatever else the table holds. The best language by text alone
    is counted by declared language, by suffix, and by whole, domain and host; each of the last three is smoothed
    by the one above it, and the row itself is left out of its host's count. The logarithms are added up. A null
    declared language, suffix, domain or host is no evidence. The unknown language gives every trigram the same
    chance; a text without letters, null or empty, has it outright, with posterior 0. Ties go to the language that
    is first in the alphabet. A row is accepted if a known language has a posterior of a half or more. Rows come
    back as often as they came; an empty table gives no rows.
    """
    names, keep = keep, [f"kept_{k}" for k in range(len(keep))]  # they may be named like a column of ours
    rows = rows.select(*(F.col(c).alias(k) for c, k in zip(names, keep)), utf8(F.col("text")).alias("text"), "declared", "suffix", "domain", "host")
    rows, languages = modelled_languages(rows)
    size = len(languages) + 1
    scored = text_evidence(rows, trigram_tables(rows, languages))
    guess = F.when(F.col("grams") > 0, F.array_position("likelihood", F.array_max("likelihood")) - 1)
    scored = stored(scored.withColumn("guess", guess), "evidence")
    prior = F.lit([(1 - UNKNOWN_PRIOR) / max(1, size - 1)] * (size - 1) + [UNKNOWN_PRIOR])
    whole = scored.agg(*(F.count_if(F.col("guess") == k).cast("double").alias(f"c{k}") for k in range(size))).first()
    whole = smoothed(F.lit([float(c) for c in whole]), prior)
    hosts = stored(level(scored, "host", "host_counts", size), "hosts")
    domains = stored(level(scored, "domain", "domain_counts", size), "domains")
    declared = stored(conditional(scored, "declared", size), "declared")
    suffixes = stored(conditional(scored, "suffix", size), "suffixes")
    joined = scored.join(hosts, "host", "left").join(domains, "domain", "left")
    joined = joined.join(declared, "declared", "left").join(suffixes, "suffix", "left")
    own = F.transform("host_counts", lambda n, k: F.when(k == F.col("guess"), n - 1.0).otherwise(n))
    nothing = F.lit([0.0] * size)
    host_prior = smoothed(own, smoothed(F.col("domain_counts"), whole))
    terms = joined.select(
        *keep,
        "grams",
        "likelihood",
        F.transform(host_prior, lambda p: F.log(p)).alias("prior"),
        F.coalesce("by_declared", nothing).alias("by_declared"),
        F.coalesce("by_suffix", nothing).alias("by_suffix"),
    )
    logs = [
        F.col("likelihood")[k] + F.col("prior")[k] + F.col("by_declared")[k] + F.col("by_suffix")[k]
        for k in range(size)
    ]
    added = terms.select(*keep, "grams", F.array(*logs).alias("logs"))
    best = added.withColumn("best", F.array_max("logs"))
    weight = F.aggregate("logs", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("best")))
    language = F.when(F.col("grams") > 0, F.get(F.lit([*languages, UNKNOWN]), F.array_position("logs", F.col("best")).cast("int") - 1))
    return (
        best.select(*keep, F.coalesce(language, F.lit(UNKNOWN)).alias("language"), (1 / weight).alias("p"), "grams")
        .withColumn("posterior", F.when(F.col("grams") > 0, F.col("p")).otherwise(0.0))
        .withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("posterior") >= LEAST_POSTERIOR))
        .select(*keep, "language", "posterior", "accepted")
        .toDF(*names, "language", "posterior", "accepted")
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """``page_id`` and the evidence of web pages: visible text, ``lang`` attribute, suffix, domain and host."""
    url, html = F.col("url"), F.coalesce(F.col("html"), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    lang = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    hidden = r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->"
    text = F.regexp_replace(F.regexp_replace(html, hidden, " "), r"<[^>]*>|&#?\w+;", " ")
    named = lambda c: F.when(c != "", c)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        text.alias("text"),
        named(lang).alias("declared"),
        named(F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)).alias("suffix"),
        named(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
        named(host).alias("host"),
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """``row_key`` and the evidence of documents: their source stands for the host; there is no suffix."""
    none = F.lit(None).cast("string")
    return docs.select(
        row_key().alias("row_key"),
        F.col("text"),
        F.lower("lang").alias("declared"),
        none.alias("suffix"),
        none.alias("domain"),
        F.col("source").cast("string").alias("host"),
    )


def row_key() -> Column:
    """One long for a row of documents: rows with the same values have the same decision."""
    return F.xxhash64("doc_id", "text", "lang", "source")


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns."""
    rejected = identify(document_evidence(docs), "row_key").where(~F.col("accepted")).select("row_key").distinct()
    name = unused(docs, "row_key")
    kept = docs.withColumn(name, row_key())
    return kept.join(rejected.toDF(name), name, "left_anti").select(*docs.columns)
