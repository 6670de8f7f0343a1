"""Secret scan: fixed patterns, plus novelty measured by dictionary-primed zstandard.

Strings in a sensitive context (a block of lines, ended by a blank one, that holds a word such as key,
token, auth, bearer or credential; the body of a PEM private key) that no fixed pattern covers are
candidates. A candidate's novelty is its marginal compressed size: bytes of surroundings and candidate
less bytes of the surroundings, both primed with a dictionary of identifiers, against the entropy bound
of the candidate's alphabet. The dictionary is trained by zstandard, so that it brings matches as well as
letter costs, on identifiers made of common words and of the words that the sensitive blocks of the
corpus hold in several documents. What the dictionary or the surroundings predict compresses away; a
random secret does not, and is reported as ``novel`` unless the letter pairs of common words explain it.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodgauge.llm.common import map_blocks, table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Maximal runs: a run that is long enough matches whole, as with + and a length test afterwards.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(r"(?ai:key|token|secret|auth|bearer|passw|passphrase|credential|signature|private)")
HINTS = ("key", "token", "secret", "auth", "bearer", "passw", "passphrase", "credential", "signature", "private")
BLANK, RUN, EQUALS = re.compile(r"\n[^\S\n]*\n"), re.compile(r"[A-Za-z0-9+/_=-]{16,}"), re.compile(r"=+(?=[^=])")
#: Begin line and headers of a private key; line ends may be written as \n. BODY: its characters.
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?:\s|\\[nrt])*[A-Z][A-Za-z-]*:\x20[^\n\\]*)*(?:\s|\\[nrt])*")
BODY, ESCAPE = re.compile(r"[A-Za-z0-9+/=]"), re.compile(r"\\[nrt]")
#: Shares of the alphabet's entropy bound: least new bits of a candidate of so many characters or less,
#: and or more (words are short; a long secret among others is cheaper, as they tell its letters), and
#: least bits by letter pairs. Characters of text on either side that prime.
NOVELTY, WORDY, AROUND = ((16, 0.97), (40, 0.8)), 0.93, 1000
#: Bytes of the trained dictionary; identifiers it is trained on; words of the corpus in it, the documents
#: that must hold one, and its letters (shorter than any candidate, so that no whole one is learned).
DICTIONARY, TRAINED_ON, CORPUS_WORDS, HOLDERS, WORD_LETTERS = 112_640, 8000, 20_000, 3, (3, 15)
#: Identifiers that programs and configurations commonly hold; they prime the dictionary.
IDENTIFIERS = (
    "access_key_id secret_access_key api_key apikey client_id client_secret private_key public_key token access_token refresh_token "
    "auth authorization bearer basic password passwd passphrase username user_name session_id session_key signature credential "
    "AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY GITHUB_TOKEN DATABASE_URL example placeholder changeme your_token_here your_api_key "
    "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890abcdef "
    "configuration environment production development application/json Content-Type http:// https:// localhost "
    "handle user login logout settings report internal host hostname external server customer account field index value name size count list array map get set add remove update "
    "delete create read write find load save send receive open close start stop begin end backup restore prod region zone test stage data file path temp cache cookie page view "
    "model table column row format date class method function error exception warning debug trace level event order product price payment invoice address street city country "
    "phone mail email main java python com org net src lib bin usr etc var local share home www form encoded kubernetes docker postgres dashboard reader thumbnail picture profile "
    "pool connection timeout singleton pointer null variable"
)


#: Common words and endings; their letter pairs tell words from random letters.
WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been "
    "has when who will no more if out so said what up its about than into them can only other time new some could these two may first then do any like my now over such our "
    "man me even most made after also did many must before through years where much way well down should because long people state world between life day great still own last "
    "never information international organization organisation communication development environment configuration authentication application administration responsibility "
    "understanding characteristic implementation specification representation transformation infrastructure documentation production resource management government department "
    "university performance technology experience relationship individual particular question example number system program process service network security certificate "
    "identity provider controller repository template container deployment password abstract singleton proxy factory object string message request response "
    "der die und das ein eine nicht ist von mit den auch auf sich dem des werden haben einer wird sind schaft heit keit lich ung ungen isch verein ander zwischen gesellschaft "
    "geschichte entwicklung verantwortung zusammenarbeit wissenschaft wirtschaft bundes regierung sicherheit gegen schlussel arbeit zeit jahr leben recht versicherung "
    "le la les et un une que qui dans pour pas sur plus par avec est sont ement ation aux eux leur cette comme mais tout bien etre avoir faire gouvernement developpement "
    "naturellement nouveau monde el los las en por con para una su al lo como mas pero sus este esta entre cuando muy sin sobre tambien hasta donde desde todo nosotros mente "
    "cion ciones amiento gobierno desarrollo universidad responsabilidad il di che non per della sono alla nel come anche zione bir ve bu icin ile olarak daha sonra gibi kadar "
    "lari leri olan de het een van niet voor"
)


@lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard


def train_dictionary(words: Iterable[str] = ()) -> bytes:
    """A zstandard dictionary of identifiers: words of the lists above and ``words``, joined in the
    common ways of naming."""
    own = re.findall("[a-z]{2,}", f"{IDENTIFIERS} {WORDS}".lower())
    pools = [sorted(set(own)), sorted(set(words))]
    rng = random.Random(7)
    samples = []
    for i in range(TRAINED_ON):
        few = rng.choices(pools[i % 2] or pools[0], k=rng.randint(2, 5))
        capital = [w.capitalize() for w in few]
        name = ["_".join(few), "-".join(few), few[0] + "".join(capital[1:]), "".join(capital), "_".join(few).upper(), "/".join(few)][i // 2 % 6]
        if i % 5 < 2:
            name += rng.choice(["", "_", "-"]) + rng.choice([f"{rng.randrange(100)}", f"v{rng.randrange(1, 10)}", f"20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}", f"T{rng.randrange(24):02}-{rng.randrange(60):02}-00Z"])
        samples.append(name.encode())
    return _zstd().train_dictionary(DICTIONARY, samples, level=12).as_bytes()


@lru_cache(maxsize=2)
def _compressor(dictionary: bytes | None):
    z = _zstd()
    params = z.ZstdCompressionParameters.from_level(12, window_log=18, min_match=3, strategy=z.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
    primed = z.ZstdCompressionDict(dictionary or train_dictionary())
    primed.precompute_compress(compression_params=params)
    return z.ZstdCompressor(dict_data=primed, compression_params=params)


def new_bits(candidate: str, before: str, after: str, dictionary: bytes | None) -> float:
    """New bits per character of ``candidate``, its surroundings and the dictionary being known."""
    compress, known = _compressor(dictionary).compress, f"{after} {before}".encode()
    return 8 * (len(compress(known + candidate.encode())) - len(compress(known))) / len(candidate)


def entropy_bound(candidate: str) -> float:
    """Bits per character of a random string in the smallest common alphabet that holds ``candidate``."""
    used = set(candidate)
    if used & set("0123456789") and any(used <= set(a) for a in ("0123456789", "0123456789abcdef", "0123456789ABCDEF")):
        return math.log2(10 if candidate.isdigit() else 16)
    size = 26 * any(c.islower() for c in used) + 26 * any(c.isupper() for c in used) + 10 * any(c.isdigit() for c in used)
    return math.log2(size + 2 * any(not c.isalnum() for c in used) if size else 64)


@lru_cache(maxsize=1)
def _pairs() -> tuple[Counter, Counter]:
    pairs = Counter(p for w in WORDS.split() for p in pairwise(f" {w} "))
    first = Counter()
    for (a, _), n in pairs.items():
        first[a] += n
    return pairs, first


def word_bits(candidate: str) -> float:
    """Bits per character by the letter pairs of common words, changes of case and separators, of which
    names repeat one."""
    pairs, first = _pairs()
    bits, last, was, seen = 0.0, " ", "", set()  # was: case of the letter before; U begins a word
    for c in candidate:
        if c.isdigit():
            bits, last, was = bits + math.log2(10) + (0.3 if last == " " else 3), " ", ""
        elif not c.isalpha():
            bits, last, was = bits + (2 if c in seen else 4), " ", ""
            seen.add(c)
        else:
            case = "l" if c.islower() else "u" if was in ("U", "u") else "U"
            bits += 1 if was in ("", "U") else 0.15 if was == case else 3.3
            last = " " if was == "l" and case == "U" else last
            bits -= math.log2((pairs[last, c.lower()] + 0.3) / (first[last] + 0.3 * 27))
            last, was = c.lower(), case
    return bits / len(candidate)


def is_novel(candidate: str, before: str, after: str, dictionary: bytes | None = None) -> bool:
    bound, ((short, high), (long, low)) = entropy_bound(candidate), NOVELTY
    least = high - (high - low) * min(1.0, max(0, len(candidate) - short) / (long - short))
    return word_bits(candidate) >= WORDY * bound and new_bits(candidate, before[-AROUND:], after[:AROUND], dictionary) >= least * bound


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start and kind."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _pem_spans(text: str, dictionary: bytes | None) -> list[tuple[int, int]]:
    """Bodies of private keys between their begin and end lines, without headers."""
    spans = []
    for m in PEM.finditer(text) if "PRIVATE KEY" in text else ():
        start, end = m.end(), text.find("-----", m.end())
        if end < 0 or not text.startswith("-----END ", end):
            continue  # cut off: its lines are candidates of their block
        body = ESCAPE.sub(lambda e: "\n" * len(e[0]), text[start:end])
        places = [p.start() for p in BODY.finditer(body)]
        joined = "".join(BODY.findall(body))
        if len(joined) >= 16 and is_novel(joined, text[max(0, m.start() - AROUND) : m.start()], text[end : end + AROUND], dictionary):
            spans.append((start + places[0], start + places[-1] + 1))
    return spans


def _sensitive(text: str):
    """(start, end) of the blocks of lines with a sensitive word."""
    start = 0
    while start < len(text):
        blank = BLANK.search(text, start)
        end = blank.start() if blank else len(text)
        if CONTEXT.search(text, start, end):
            yield start, end
        start = end + 1 if blank else end


def _candidates(text: str):
    """(start, end) of the strings of 16 characters or more in blocks with a sensitive word."""
    for block in _sensitive(text):
        for m in RUN.finditer(text, *block):
            parts, at = [], m.start()  # name=value gives its value
            for e in [*EQUALS.finditer(text, m.start(), m.end()), None]:
                stop = e.start() if e else m.end()
                if stop - at >= 16:
                    parts.append((at, stop))
                at = e.end() if e else stop
            yield from parts or [m.span()]


def novel_spans(text: str, base: list[tuple[int, int, int]], dictionary: bytes | None = None) -> list[tuple[int, int, int]]:
    """Bodies of private keys, and other incompressible strings in a sensitive context that overlap
    neither these nor a base span. Words, identifiers and repeats of the surroundings fall under the
    bound."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    pem = _pem_spans(text, dictionary)
    spans = [(a, 3, b) for a, b in pem]
    taken: list[list[int]] = []
    for a, b in sorted([(a, b) for a, _, b in base] + pem):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    ends = [b for _, b in taken]
    for start, end in _candidates(text):
        i = bisect_left(ends, start + 1)
        if i < len(taken) and taken[i][0] < end:
            continue
        if is_novel(text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND], dictionary):
            spans.append((start, 3, end))
    return sorted(spans)


def coded(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_NAME = re.compile(f"[A-Z]?[a-z]{{{WORD_LETTERS[0] - 1},}}|[A-Z]{{{WORD_LETTERS[0]},}}|[a-z]{{{WORD_LETTERS[0]},}}")


def corpus_dictionary(docs: DataFrame, most: int = CORPUS_WORDS, holders: int = HOLDERS) -> bytes:
    """A dictionary from the words (parts of names) that sensitive blocks of at least ``holders``
    documents hold: counted over all documents, the ``most`` frequent of them go to the driver."""

    def block(cols: dict[str, list]) -> dict[str, list]:
        counts: Counter[str] = Counter()
        for text in cols["text"]:
            low = (text or "").lower()
            if any(h in low for h in HINTS):
                counts.update({w.lower() for span in _sensitive(text) for w in _NAME.findall(text, *span) if len(w) <= WORD_LETTERS[1]})
        return {"word": list(counts), "n": list(counts.values())}

    counted = map_blocks(docs.select("text"), block, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= holders).orderBy(F.desc("n"), "word").limit(most).collect()
    return train_dictionary([r["word"] for r in rows])


def find_secrets(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points).

    ``dictionary`` is learned from ``docs`` where it is not given. Null text counts as empty and has no
    spans; base_sha256 is then the digest of nothing. Rows are independent: repeated rows and a null
    doc_id are rows like any other, an empty table gives no rows, a very long text is searched whole;
    other columns are ignored.
    """
    dictionary = dictionary or corpus_dictionary(docs)

    def block(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in cols["text"]:
            base = base_spans(text or "")
            kinds = [k for _, k, _ in base]
            every = coded(sorted(base + novel_spans(text or "", base, dictionary)))
            row = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(coded(base).encode()).hexdigest(), every)
            for k, v in zip(out, row):
                out[k].append(v)
        return {"doc_id": cols["doc_id"], **out}

    return map_blocks(docs.select("doc_id", "text"), block, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mask: str = "[REDACTED]", dictionary: bytes | None = None) -> str | None:
    """``text`` with every span, overlapping ones joined, replaced by ``mask``."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for a, _, b in sorted(base + novel_spans(text, base, dictionary)):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """``docs`` with the secrets of each text masked, and n_chars, where there is such a column, brought
    up to date. Null texts stay null; all rows and columns stay."""
    columns, dictionary = docs.columns, dictionary or corpus_dictionary(docs)

    def block(cols: dict[str, list]) -> dict[str, list]:
        cols["text"] = [redact(t, dictionary=dictionary) for t in cols["text"]]
        if "n_chars" in cols:
            cols["n_chars"] = [n if t is None else len(t) for n, t in zip(cols["n_chars"], cols["text"])]
        return {c: cols[c] for c in columns}

    return map_blocks(docs, block, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
