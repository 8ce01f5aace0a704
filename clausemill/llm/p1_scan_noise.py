"""Problem 1: noise in text from scanned pages, found and repaired.

Words are counted over all records. Each word meets, by an equi-join on anagram hashes, the
words from which it differs by a known confusion of characters: the difference of two
anagram hashes is the same for every word with that confusion. A rare word with a much more
frequent variant is a misreading, ranked by the variant's frequency. Running headers are
lines set like titles that come back within a file; the words that such lines carry beside
names, in many files, are learned from them (no list of words is given). Page numbers have
their few shapes, and a hyphen at a line's end is held against the counts of the joined and
the hyphenated word.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.session import materialise, read

#: Fixed values: (as misread, as printed).
CONFUSIONS = (
    ("c", "e"), ("f", "e"), ("5", "s"), ("8", "b"), ("6", "b"), ("6", "g"), ("9", "g"), ("q", "g"),
    ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"), ("l", "i"), ("i", "l"), ("†", "t"), ("г", "r"),
    ("ä", "a"), ("ri", "n"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("in", "m"), ("nn", "m"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"),
    ("b", "h"), ("h", "b"), ("h", "li"), ("li", "h"), ("v", "y"), ("y", "v"), ("vv", "w"), ("w", "vv"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
)
MARKS = "-‐¬\xad"
NUMERAL = r"(?:\d{1,4}|[ivxl]{1,7})"
PAGE = rf"(?:\[\s*(?:[Pp]age\s*)?{NUMERAL}\s*\]|~\s*{NUMERAL}\s*~|[-–—]\s*{NUMERAL}\s*[-–—]|(?i:page|pg\.?|p\.)\s*{NUMERAL}(?:\s*(?:of|/)\s*{NUMERAL})?|\d{{1,4}}\s*/\s*\d{{1,4}})"
BARE = re.compile(rf"^\s*(?:{PAGE}|{NUMERAL})\s*$")
AT_EDGE = re.compile(rf"^\s*(?:{PAGE})\s*[|•·]?\s*|\s*[|•·]?\s*(?:{PAGE})\s*$|(?<=\S)(?:\s{{2,}}|\s*[|•·]\s*){NUMERAL}\s*$|^\s*{NUMERAL}(?:\s{{2,}}|\s*[|•·]\s*)(?=\S)")
JOINS = r"(?!(?:and|or|to|und|oder|bis|et|ou|en|of)\b)"
BREAK = re.compile(rf"(?<=\w)(?:-[ \t]*\n\s*{JOINS}|[‐¬\xad]\s*|-[ \t]+{JOINS}(?=[^\W\d_A-Z]))(?=\w)")
#: A page number inside a line whose breaks became blanks.
INLINE_PAGE = re.compile(rf"(?:\[\s*(?:[Pp]age\s*)?{NUMERAL}\s*\]|(?<!\S)~\s*{NUMERAL}\s*~(?!\S)|(?<!\S)[-–—]\s*{NUMERAL}\s*[-–—](?!\S)|\b(?:[Pp]age|[Pp]g\.?|[Pp]\.)\s*\d{{1,4}}(?:\s*(?:of|/)\s*\d{{1,4}})?(?!\w)|(?<!\S)\d{{1,4}}\s*/\s*\d{{1,4}}(?!\S))")
INLINE_BARE = re.compile(r"(?<!\S)([^\W\d_]{2,}[,;:]?) ((?:\d{1,3}|[ivxl]{2,6}|[vx]))(?= +([^\W\d_]+))")
LONE = re.compile(r" (\d{1,3}|[ivxl]{1,6})(?= )")
PREVIOUS = re.compile(r"(?<!\S)([^\W\d_]{2,}[,;:]?)\Z")
NEXT = re.compile(r"\w? +([^\W\d_]+)")
ROMANS = frozenset(r for t in ("", "x", "xx", "xxx", "xl", "l") for u in ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix") if (r := t + u))
NUMBERS = ROMANS | {str(i) for i in range(1000)}
#: A capitalised word of a header's run, misread or not.
CAPS = r"(?:\(?[^\W\d_a-zß-öø-ÿ][^\s]*|\(?[0165|!](?=[A-Z])[^\s]*)"
#: Two words in a row that begin small: no title has them.
PROSE = re.compile(r"(?:^|\s)[a-zß-öø-ÿ][^\s]*\s+[a-zß-öø-ÿ]")
SPLITTER = str.maketrans({c: " " for c in ".,;:()[]{}“”\"'’‘«»—–/~?*+=<>§•·_&%$€#@\\"})
ASCII_LOWER = bytes(32 if chr(i) in ".,;:()[]{}\"'/~?*+=<>_&%$#@\\" else ord(chr(i).lower()) for i in range(128)) + bytes(range(128, 256))
ODD = re.compile(r"[015689|!†гﬁﬂﬀﬃﬄ]")
NUMBERED = re.compile(r"^\s*(?:clause\s+)?\d+(?:\.\d+)*[.)]?\s+\S", re.I)


def words_of(text: str) -> list[str]:
    """Lower-cased words; words divided at a line's end are joined, page marks don't matter."""
    return low_words(BREAK.sub("", text) if divided(text) else text)


def low_words(text: str) -> list[str]:
    """Lower-cased words between the splitting marks; plain texts by one table of bytes."""
    if text.isascii():
        return text.encode().translate(ASCII_LOWER).decode().split()
    return text.lower().translate(SPLITTER).split()


def divided(text: str) -> bool:
    """A quick look for marks that may divide a word."""
    return "-\n" in text or "- " in text or "-\t" in text or "‐" in text or "¬" in text or "\xad" in text


def bare_numbers(text: str, words: list[str]) -> list[tuple[str, str]]:
    """(word before, word after) of each bare number or numeral inside a line; ``words``: the text's words."""
    if NUMBERS.isdisjoint(words):
        return []
    out = []
    for m in LONE.finditer(text):
        before = PREVIOUS.search(text, max(0, m.start() - 60), m.start())
        after = NEXT.match(text, m.end() - 1)
        if before and after and m.group(1) not in ("i", "l"):
            out.append((before.group(1), after.group(1)))
    return out


def word_counts(records: DataFrame) -> DataFrame:
    """(word, n) over all texts of ``records`` (text); counted in the map before the shuffle.

    Beside the words stand ``#word`` and ``##word``: how often a bare number follows or precedes the word in a line.
    """

    def run(batches):
        n: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = words_of(t)
                n.update(words)
                for before, after in bare_numbers(t, words):
                    n.update(("#" + before.lower().rstrip(",;:"), "##" + after.lower()))
            if len(n) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), type=pa.int64())], names=["word", "n"])
                n.clear()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), type=pa.int64())], names=["word", "n"])

    counted = records.where("text is not null").select("text").mapInArrow(run, "word string, n long")
    word = F.regexp_replace("word", r"^-+|[!?\-‐¬\x{ad}]+$", "")
    return counted.groupBy(word.alias("word")).agg(F.sum("n").alias("n")).where(F.length("word").between(2, 60))


def anagram_hash(word: F.Column) -> F.Column:
    """A sum over the word's characters, so that a confusion changes it by a constant."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: a + F.when(c == "", F.lit(0).cast("long")).otherwise(F.shiftright(F.xxhash64(c), 16)))


def corrections(counts: DataFrame, ratio: int = 12, odd_ratio: int = 1) -> DataFrame:
    """(word, good, n, n_good, place): each misread word with its variants, the best at place 1.

    The variant must be ``ratio`` times as frequent; words with a character that no word
    has (a digit inside letters and the like) need ``odd_ratio``.
    """
    spark = counts.sparkSession
    w = counts.where(F.col("word").rlike(r"\A[^#].*\p{L}|\A\p{L}")).withColumn("h", anagram_hash(F.col("word")))
    pairs = spark.createDataFrame([(b, g, k) for b, g in CONFUSIONS for k in (1, 2, 3, 4)], "bad string, right string, k int")
    diff = pairs.withColumn("d", (anagram_hash(F.col("bad")) - anagram_hash(F.col("right"))) * F.col("k"))
    # A word is held against the confusions whose misread side it shows.
    shown = (F.length("word") - F.length(F.replace("word", "bad", F.lit("")))) / F.length("bad")
    bad = w.join(F.broadcast(diff), shown >= F.col("k")).select("word", "n", "bad", "right", (F.col("h") - F.col("d")).alias("h"))
    good = w.where(F.col("n") >= 2).select(F.col("word").alias("good"), F.col("n").alias("n_good"), "h")
    same = F.replace("word", "bad", "right") == F.replace("good", "bad", "right")
    odd = F.col("word").rlike(r"[\p{L}][015689|!†гﬁﬂﬀﬃﬄ]|[015689|!†гﬁﬂﬀﬃﬄ][\p{L}]") & ~F.col("good").rlike(r"[\d|!†гﬁﬂ]")
    need = F.when(odd, F.col("n") * odd_ratio).otherwise(F.col("n") * ratio)
    found = bad.join(good, "h").where(same & (F.col("word") != F.col("good")) & (F.col("n_good") >= need))
    # Several confusions in one word: equal when all confusable characters are folded.
    def fold(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([skeleton(x) for x in batch.column(0).to_pylist()], type=pa.string())], names=["word", "n", "key"])

    folded = w.where(F.length("word") >= 5).select("word", "n").mapInArrow(fold, "word string, n long, key string")
    top = folded.groupBy("key").agg(F.max_by(F.struct("word", "n"), F.struct("n", "word")).alias("t"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", F.col("t.word").alias("good"), F.col("t.n").alias("n_good"))
    several = folded.join(top, "key").where((F.col("word") != F.col("good")) & (F.col("n_good") >= F.col("n") * ratio)).select("word", "good", "n", "n_good", F.lit(2).alias("round"))
    found = found.select("word", "good", "n", "n_good", F.lit(1).alias("round")).unionByName(several)
    best = found.groupBy("word", "good").agg(F.first("n").alias("n"), F.first("n_good").alias("n_good"), F.min("round").alias("round"))
    return best.withColumn("place", F.row_number().over(W.partitionBy("word").orderBy("round", F.desc("n_good"), "good"))).drop("round")


PAIRS = (("ﬁ", "fi"), ("ﬂ", "fl"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("li", "h"), ("in", "m"))
FOLD = str.maketrans("0561|!i†гä9q8vbfc", "oshlllltragghyhee")
NO_WORD = re.compile(r"[\W_]+")


def skeleton(line: str) -> str:
    """A line's letters with confusable characters folded, for lines that are the same but for misreadings."""
    s = line.lower()
    for b, g in PAIRS:
        if b in s:
            s = s.replace(b, g)
    return NO_WORD.sub("", s.translate(FOLD))


DIGIT = re.compile(r"\d")
EDGE_MARKS = "[]~()-–—|•· "


def may_page(line: str) -> bool:
    """A quick look whether a line may hold a page number."""
    if DIGIT.search(line):
        return True
    ends = line.split()
    return bool(ends) and any(x.strip(EDGE_MARKS) in ROMANS for x in (ends[0], ends[-1], ends[-2] if len(ends) > 1 else "", ends[1] if len(ends) > 1 else ""))


def strip_page(line: str) -> tuple[str, bool]:
    """A line without a page number at its edge, and whether it had one (or was one)."""
    if not may_page(line):
        return line, False
    if BARE.match(line):
        return "", True
    out = AT_EDGE.sub("", line)
    return (out.strip(), out != line) if out.strip() else ("", True)


def title_words(line: str) -> tuple[list[str], list[str]] | None:
    """The words of a line that is set like a title, and those of them that begin small; null for any other line."""
    if PROSE.search(line) or line.rstrip().endswith((".", ";", ",")):
        return None
    words = [w for w in WORD.findall(line) if len(w) >= 2]
    small = [w for w in words if w[0].islower()]
    return (words, small) if len(words) >= 2 and 2 * len(small) < len(words) else None


WORD = re.compile(r"[^\W\d_][^\s]*")
EDGES = ".,;:()[]{}"


def plain_words(words: list[str]) -> list[str]:
    return [w.lower().strip(EDGES) for w in words]


def edge_lines(records: DataFrame) -> DataFrame:
    """(doc_id, key, small, beside, pairs, named): title-like lines that come back within a file, by their folded letters' hash.

    ``small``: words that begin small; ``beside`` and ``pairs``: words, and neighbouring words, that the file's name
    hasn't; ``named``: whether the line has a word of the file's name.
    """

    def run(batches):
        names: dict[str, set[str]] = {}
        for batch in batches:
            out: list[tuple] = []
            for doc, rec, no, text, name in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if text is None or doc is None or (no == 0 and "\n" not in text):
                    continue
                for line in text.split("\n"):
                    if 6 <= len(line) <= 160 and not PROSE.search(line) and not NUMBERED.match(line):
                        line, _ = strip_page(line.strip())
                        found = title_words(line) if len(line) >= 6 else None
                        if found is None:
                            continue
                        base = names.get(name or "")
                        if base is None:
                            if len(names) > 5000:
                                names.clear()
                            base = names[name or ""] = name_words(name)
                        words = plain_words(found[0])
                        own = [skeleton(w) in base for w in words]
                        pairs = [f"{a} {b}" for a, b, x, y in zip(words, words[1:], own, own[1:], strict=False) if not (x or y)]
                        out.append((doc, skeleton(line), rec, plain_words(found[1]), [w for w, o in zip(words, own, strict=True) if not o], pairs, any(own)))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), texts, texts, texts, pa.bool_()), strict=True)], names=["doc_id", "line", "rec", "small", "beside", "pairs", "named"])

    lines = records.select("doc_id", "rec", "para_no", "text", "name").mapInArrow(run, "doc_id long, line string, rec long, small array<string>, beside array<string>, pairs array<string>, named boolean")
    by = lines.withColumn("key", F.xxhash64("line")).groupBy("doc_id", "key")
    seen = by.agg(F.min("rec").alias("a"), F.max("rec").alias("b"), F.min("small").alias("small"), F.min("beside").alias("beside"), F.min("pairs").alias("pairs"), F.max("named").alias("named"))
    return seen.where("a < b").drop("a", "b")


def furniture(lines: DataFrame, share: float = 0.02, least: int = 3) -> tuple[list[str], list[str], list[str]]:
    """(words, small words, pairs of words) that the running lines of many files carry beside their names.

    Learned from edge_lines(): those that stand in ``share`` of all files with a running line that names the
    file, and in ``least`` files. At most 1 / ``share`` times a file's words can, however many files there are.
    """
    named = lines.where("named and doc_id is not null")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("x")) for k in ("beside", "small", "pairs")))
    each = named.select("doc_id", F.inline(kinds)).select("doc_id", "kind", F.explode("x").alias("word")).distinct()
    files = named.select("doc_id").distinct().count()
    often = each.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(least, share * files)).collect()
    words = {r.word for r in often if r.kind == "beside" and len(r.word) >= 2}
    return sorted(words), sorted({r.word for r in often if r.kind == "small"} & words), sorted(r.word for r in often if r.kind == "pairs" and set(r.word.split()) <= words)


def loose(words: str) -> str:
    """A pattern for words with or without misread letters, from the confusions."""
    read: dict[str, list[str]] = {}
    for bad, good in CONFUSIONS:
        if len(good) == 1:
            read.setdefault(good, []).append(bad)
    one = lambda c: r"\s+" if c == " " else "(?:" + "|".join(map(re.escape, [c, *read.get(c, ())])) + ")"
    return "".join(map(one, words))


class Layout:
    """What headers look like, from furniture()."""

    def __init__(self, words: list[str], small: list[str], pairs: list[str]):
        self.plain = frozenset(map(skeleton, words))
        self.small = frozenset(map(skeleton, small))
        self.pairs = pairs
        #: Each pair in two halves: a misread letter spoils one of them.
        self.halves = [h for p in pairs for n in [len(p.replace(" ", "")) // 2] for h in (p[:n].strip(), p[n:].strip()) if h]
        joins = "".join(loose(w) + "|" for w in small)
        self.run = re.compile(rf"(?<!\S){CAPS}(?:\s+(?:{CAPS}|(?:{joins}—|/)(?!\S)))*", re.UNICODE)
        self.marker = re.compile("|".join(["—", r"\s/\s", *(rf"(?<!\w){loose(p)}(?!\w)" for p in pairs)]), re.I)

    def titled(self, line: str) -> bool:
        """Whether a line is set like a title, its small words are those of headers, and it has another word."""
        found = title_words(line)
        if found is None:
            return False
        words, small = found
        return all(skeleton(w) in self.small for w in small) and any(skeleton(w) not in self.plain for w in words)

    def signs(self, low: str) -> bool:
        """A quick look whether a lower-cased text may hold a header, misread or not."""
        return "—" in low or " / " in low or any(h in low for h in self.halves)
    def furnished(self, low: str) -> bool:
        """Whether a lower-cased line may hold a header or a page number."""
        return "- " in low or " / " in low or "page " in low or "pg. " in low or "p. " in low or any(p in low for p in self.pairs)


class Reader:
    """Finds and repairs the noise of one record."""

    def __init__(self, bad: dict[str, str], known: dict[str, int], layout: Layout, most: int, texts: bool = True):
        self.bad, self.known, self.layout, self.most, self.texts = bad, known, layout, most, texts

    def untouched(self, text: str, keys) -> bool:
        """Whether nothing can be wrong with a text: one line, no odd character, no misread word."""
        if not ODD_CHARS.isdisjoint(text) or (len(text) <= 160 and (keys or BARE.match(text) or self.layout.titled(text))):
            return False
        low = text.lower()
        words = low_words(text)
        if self.layout.furnished(low) or self.suspicious(words):
            return False
        return all(self.number_fits(before, after) for before, after in bare_numbers(text, words))

    def is_header(self, line: str, repeated: bool, name: set[str], head: bool) -> bool:
        if head or NUMBERED.match(line) or not self.layout.titled(line):
            return False
        if repeated:
            return True
        words = [skeleton(w) for w in re.findall(r"[^\W_]+", line) if len(w) >= 4]
        hits = sum(w in name for w in words)
        rest = [w for w in words if w not in name and w not in self.layout.plain]
        return hits >= 2 and len(rest) == 0

    def joined(self, left: str, right: str, mark: str) -> bool:
        """Whether a mark between two parts, at a line's end, divides a word."""
        if mark != "-":
            return True
        a, b = left.lower(), right.lower()
        whole, with_mark = self.known.get(a + b, 0), self.known.get(f"{a}-{b}", 0)
        if a + b in self.bad:
            return True
        if with_mark or whole:
            return whole > with_mark and not (b in SMALL_JOINS and whole < 5)
        return not (b in SMALL_JOINS or (self.known.get(a, 0) and self.known.get(b, 0)))

    def read(self, text: str, repeated, name: set[str], head: bool) -> tuple[set[str], str]:
        """The kinds of noise of a record and its text as continuous paragraphs."""
        noise: set[str] = set()
        kept: list[str] = []
        removed: list[str] = []
        first = low_words(text)
        numbers = not NUMBERS.isdisjoint(first) or any(not w.isalpha() and w.isdigit() for w in first)
        for line in text.split("\n"):
            bare = line.strip()
            if not bare:
                kept.append("")
                continue
            if not (numbers and may_page(bare)) and PROSE.search(bare):
                kept.append(line)
                continue
            rest, page = strip_page(bare) if len(bare) <= 160 else (bare, False)
            if page and not rest and not self.page_fits(bare, kept):
                rest, page = bare, False
            header = bool(rest) and len(rest) <= 160 and self.is_header(rest, repeated(rest), name, head and "\n" not in text.strip())
            if page and (header or not rest):
                noise.add("pageno")
                if header:
                    noise.add("header")
                    removed.append(rest)
                continue
            if header:
                noise.add("header")
                removed.append(rest)
                continue
            kept.append(line)
        body = "\n".join(kept)
        for r in removed:
            if any(self.misread(w) for w in low_words(r)):
                noise.add("glyph")

        body = self.inline(body, noise, repeated, name, numbers)

        def join(m: re.Match) -> str:
            mark = m.group(2)
            if self.joined(m.group(1), m.group(3), mark[0]):
                noise.add("hyphen")
                return m.group(1) + m.group(3)
            return m.group(1) + mark.strip() + ("" if "\n" in mark and mark[0] == "-" else " ") + m.group(3)

        for _ in range(2):
            if not divided(body):
                break
            body = DIVIDED.sub(join, body)

        def mend(m: re.Match) -> str:
            w = m.group(0)
            good = self.misread(w.lower() if w.lower() in self.bad else w.lower().rstrip("!?"))
            if good is None:
                return w
            noise.add("glyph")
            if w.isupper() or (len(w) > 3 and sum(c.isupper() for c in w) * 2 > sum(c.isalpha() for c in w)):
                return good.upper()
            return good[:1].upper() + good[1:] if w[:1].isupper() else good

        if self.suspicious(first if body is text else low_words(body)):
            if not self.texts:
                noise.add("glyph")
                return noise, ""
            body = TOKEN.sub(mend, body)
        return noise, " ".join(body.split()) if self.texts else ""

    def inline(self, body: str, noise: set[str], repeated, name: set[str], numbers: bool) -> str:
        """Headers and page numbers inside a line, taken out."""

        def page(m: re.Match) -> str:
            noise.add("pageno")
            return " "

        low = body.lower()
        if numbers and page_signs(low):
            body = INLINE_PAGE.sub(page, body)

        def header(m: re.Match) -> str:
            run = m.group(0)
            if not self.layout.marker.search(run):
                return run
            tokens = run.split()
            fits = lambda t: skeleton(t) in name or skeleton(t) in self.layout.plain or t in ("—", "/")
            a, b = 0, len(tokens)
            # A line that comes back in the file shows how far the header goes.
            spans = ((x, y) for x in range(min(4, b - 1)) for y in range(b, max(x + 1, b - 3), -1))
            a, b, exact = next(((x, y, True) for x, y in spans if y - x >= 2 and repeated(" ".join(tokens[x:y]))), (a, b, False))
            # The run may have caught capitalised words of the sentence on either side.
            while not exact and b - a > 3 and not fits(tokens[b - 1]) and self.known.get(tokens[b - 1].lower(), 0) * 60 > self.most:
                b -= 1
            while not exact and b - a > 3 and not fits(tokens[a]) and (skeleton(tokens[a]) not in name) and self.known.get(tokens[a].lower(), 0) and any(fits(t) for t in tokens[a + 1 : a + 3]) and tokens[a] != tokens[a].upper():
                a += 1
            if b - a < 3 and not exact:
                return run
            noise.add("header")
            if any(self.misread(w) for t in tokens[a:b] for w in low_words(t)):
                noise.add("glyph")
            return " ".join([*tokens[:a], *tokens[b:]])

        if self.layout.signs(low) and self.layout.marker.search(body):
            body = "\n".join(self.layout.run.sub(header, line) if self.layout.marker.search(line) else line for line in body.split("\n"))

        def bare(m: re.Match) -> str:
            if self.number_fits(m.group(1), m.group(3)):
                return m.group(0)
            noise.add("pageno")
            return m.group(1)

        return INLINE_BARE.sub(bare, body) if numbers else body

    def number_fits(self, before: str, after: str) -> bool:
        """Whether a bare number is usual behind or before these words."""
        b, a = before.lower().rstrip(",;:"), after.lower()
        return self.known.get("#" + b, 0) * 20 > self.known.get(b, 0) or self.known.get("##" + a, 0) * 20 > self.known.get(a, 0)

    def page_fits(self, line: str, before: list[str]) -> bool:
        """A bare number is a page's unless the line before stops where a number belongs."""
        if not re.fullmatch(r"\s*(?:\d{1,4}|[ivxl]+)\s*", line):
            return True
        last = next((x for x in reversed(before) if x.strip()), "")
        return not re.search(r"(?:\b(?:than|clause|clauses|within|for|of|pays|section|annex|schedule)|[§,])\s*\Z", last.strip(), re.I)

    def suspicious(self, words: list[str]) -> bool:
        """Whether one of the lower-cased words may be misread."""
        if not self.bad.keys().isdisjoint(words):
            return True
        for w in words:
            if not w.isalpha() and not w.isdigit() and self.misread(w.rstrip("!?")) is not None:
                return True
        return False

    def misread(self, w: str) -> str | None:
        good = self.bad.get(w)
        if good is not None:
            return good
        if ODD.search(w) and ODD_WORD.match(w) and w not in self.known:
            return w.translate(ODD_FOLD)
        return None


SMALL_JOINS = frozenset("and or to und oder bis et ou en of".split())
DIVIDED = re.compile(r"([^\W\d_](?:[\w|!†]*[\w|!†])?)(-[ \t]*\n\s*|-[ \t]+(?=[^\W\d_])|[‐¬\xad]\s*)([^\W_][\w|!†]*)")
TOKEN = re.compile(r"[^\s.,;:()\[\]{}“”\"'’‘«»—–/~?*+=<>§•·_&%$€#@\\]{2,60}")
ODD_FOLD = str.maketrans({"0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g", "|": "l", "!": "i", "†": "t", "г": "r", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"})
#: A word of letters with odd characters inside; not an ordinal, a code or a number with a unit.
ODD_WORD = re.compile(r"^(?=(?:[^\W\d_]|[015689|!†ﬁﬂ])+$)(?!\d+(?:st|nd|rd|th|de|ste|er|e|º|ª)?$)(?!.*\d{3})(?!\d+[a-z]\d+)(?!.*!$)(?=(?:.*[^\W\d_]){2}).*[015689|!†гﬁﬂﬀﬃﬄ]")


def clean(records: DataFrame, ratio: int = 12, most: int = 1_000_000, texts: bool = True) -> DataFrame:
    """(rec_table, rec_id, noise array, text): each record's kinds of noise and its repaired text.

    Without ``texts`` only records with noise come, their text null.

    ``records``: rec_table, rec_id, doc_id, name, para_no, text. Null ids are left out; a
    null text stays null and has no noise, an empty one stays empty; rows that repeat an
    id count once; other columns are ignored. Corrections, known hyphenated words and
    edge lines are broadcast up to ``most`` rows each; beyond it each record meets its own
    words and lines by shuffled joins (see _apart), with the same result.
    """
    spark = records.sparkSession
    records = records.where("rec_id is not null")
    counts = materialise(word_counts(records))
    fixes = materialise(corrections(counts, ratio).where("place = 1").select("word", "good"))
    lines = materialise(edge_lines(records.withColumn("rec", F.xxhash64("rec_table", "rec_id"))))
    carried = furniture(lines)
    # A line with a small word that headers don't carry is none.
    edges = lines.where(F.size(F.array_except("small", F.array(*map(F.lit, carried[1])).cast("array<string>"))) == 0).select("doc_id", "key")
    top = counts.agg(F.max("n")).first()[0] or 0
    # Evidence for hyphens: words that stand hyphenated inside a line, and the words of their joined forms.
    evidence = counts.where((F.col("n") >= 2) | F.col("word").contains("-")).select("word", "n")
    n_fix, n_edge, n_known = fixes.count(), edges.count(), evidence.count()
    if max(n_fix, n_edge, n_known) > most:
        return _apart(records, fixes, evidence, edges, carried, top, texts)
    shared = spark.sparkContext.broadcast(
        (
            {r.word: r.good for r in fixes.toArrow().to_pandas().itertuples()},
            {r.word: r.n for r in evidence.toArrow().to_pandas().itertuples()},
            _edge_dict(edges.toArrow()),
        )
    )

    def run(batches):
        bad, known, edge = shared.value
        reader = Reader(bad, known, Layout(*carried), top, texts)
        nothing = frozenset()
        names: dict[str, set[str]] = {}
        for batch in batches:
            out = [_one(reader, text, edge.get(doc, nothing), names, name, no) for text, doc, name, no in zip(*(batch.column(i).to_pylist() for i in (5, 2, 3, 4)), strict=True)]
            yield _result(batch, out, texts)

    return records.select("rec_table", "rec_id", "doc_id", "name", "para_no", "text").mapInArrow(run, RESULT)


RESULT = "rec_table string, rec_id long, noise array<string>, text string"


def _one(reader: Reader, text: str | None, keys, names: dict[str, set[str]], name: str | None, no: int | None) -> tuple:
    """The kinds of noise of a record and its repaired text. ``names``: the words of the names met so far."""
    if not text:
        return (), text
    if reader.untouched(text, keys):
        return (), " ".join(text.split()) if reader.texts else None
    import xxhash

    base = names.get(name or "")
    if base is None:
        if len(names) > 5000:
            names.clear()
        base = names[name or ""] = name_words(name)
    noise, fixed = reader.read(text, lambda line: bool(keys) and spark_hash(xxhash, skeleton(line)) in keys, base, no == 0)
    return sorted(noise), fixed


def _result(batch: pa.RecordBatch, out: list[tuple], texts: bool) -> pa.RecordBatch:
    if not texts:
        some = [i for i, o in enumerate(out) if o[0]]
        batch, out = batch.take(pa.array(some, type=pa.int64())), [(out[i][0], None) for i in some]
    return pa.RecordBatch.from_arrays([batch.column("rec_table"), batch.column("rec_id"), pa.array([o[0] for o in out], type=pa.list_(pa.string())), pa.array([o[1] for o in out], type=pa.string())], names=["rec_table", "rec_id", "noise", "text"])


class Answers(dict):
    """A part of a dictionary that notes what it is asked beyond the words in ``told``."""

    def __init__(self, values: dict, told: set[str], asked: set[str]):
        super().__init__(values)
        self.told, self.asked = told, asked

    def __contains__(self, word) -> bool:
        if word not in self.told:
            self.asked.add(word)
        return super().__contains__(word)

    def get(self, word, default=None):
        return super().get(word, default) if word in self else default

    def keys(self):
        return self

    def isdisjoint(self, words) -> bool:
        return not any([w in self for w in words])


def _apart(records: DataFrame, fixes: DataFrame, evidence: DataFrame, edges: DataFrame, carried: tuple, top: int, texts: bool) -> DataFrame:
    """clean() without a dictionary in any one place.

    Each record is read with the words it has been told, and notes the others that it asks
    for; these are joined with the tables, until no record asks for a further word. The last
    reading has thus had a true answer to every question, as with the whole dictionaries.
    """
    facts = materialise(fixes.join(evidence, "word", "full_outer").select("word", "good", "n"))
    lines = edges.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("key").alias("keys"))
    rows = records.select("rec_table", "rec_id", "doc_id", "name", "para_no", "text").withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows.join(lines, F.col("doc_id").eqNullSafe(F.col("__doc")), "left").drop("__doc"))

    def outcomes(batch, names, layout):
        for text, name, no, keys, told in zip(*(batch.column(c).to_pylist() for c in ("text", "name", "para_no", "keys", "told")), strict=True):
            words, asked = {t["word"] for t in told or ()}, set()
            bad = Answers({t["word"]: t["good"] for t in told or () if t["good"] is not None}, words, asked)
            known = Answers({t["word"]: t["n"] for t in told or () if t["n"] is not None}, words, asked)
            yield _one(Reader(bad, known, layout, top, texts), text, frozenset(keys or ()), names, name, no), asked

    def ask(batches):
        names, layout = {}, Layout(*carried)
        for batch in batches:
            pairs = [(row, w) for row, (_, asked) in zip(batch.column("row").to_pylist(), outcomes(batch, names, layout), strict=True) for w in asked]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], type=pa.int64()), pa.array([w for _, w in pairs], type=pa.string())], names=["row", "word"])

    def run(batches):
        names, layout = {}, Layout(*carried)
        for batch in batches:
            yield _result(batch, [o for o, _ in outcomes(batch, names, layout)], texts)

    asked = None
    while True:
        if asked is None:
            state = rows.withColumn("told", F.lit(None).cast("array<struct<word:string,good:string,n:bigint>>"))
        else:
            told = asked.join(facts, "word", "left").groupBy("row").agg(F.collect_list(F.struct("word", "good", F.col("n").cast("long").alias("n"))).alias("told"))
            state = materialise(rows.join(told, "row", "left"))
        new = materialise(state.mapInArrow(ask, "row long, word string"))
        if new.isEmpty():
            return state.mapInArrow(run, RESULT)
        asked = new if asked is None else asked.unionByName(new)


def name_words(name: str | None) -> set[str]:
    """Folded words of a path's file name."""
    return {skeleton(w) for w in re.findall(r"[^\W_]+", (name or "").replace("%20", " ").replace("\\", "/").rpartition("/")[2]) if len(w) >= 4}


def spark_hash(xxhash, text: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def _edge_dict(table: pa.Table) -> dict[int, frozenset[int]]:
    out: dict[int, set[int]] = {}
    for d, k in zip(table.column("doc_id").to_pylist(), table.column("key").to_pylist(), strict=True):
        out.setdefault(d, set()).add(k)
    return {d: frozenset(k) for d, k in out.items()}


#: Quick looks before the patterns: what page numbers and headers, misread or not, leave in a text.
def page_signs(low: str) -> bool:
    return "[" in low or "~" in low or " -" in low or "- " in low or "–" in low or "—" in low or "/" in low or "page" in low or "pg" in low or "p." in low


ODD_CHARS = frozenset("\n\t‐¬\xad†г|!ﬁﬂﬀﬃﬄ—~[")


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and clause bodies in one shape."""
    p = read(spark, sf_dir, "paragraphs").select(F.lit("paragraph").alias("rec_table"), F.col("para_id").alias("rec_id"), "doc_id", F.col("file_name").alias("name"), "para_no", "text")
    c = read(spark, sf_dir, "clauses").select(F.lit("clause").alias("rec_table"), F.col("clause_id").alias("rec_id"), "doc_id", F.col("rel_path").alias("name"), F.lit(None).cast("int").alias("para_no"), F.col("body").alias("text"))
    return p.unionByName(c)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean(records_of(spark, sf_dir), texts=False).select("rec_table", "rec_id", F.explode("noise").alias("noise"))
    return found.dropDuplicates()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired texts of all records."""
    return clean(records_of(spark, sf_dir)).select("rec_table", "rec_id", "text").dropDuplicates(["rec_table", "rec_id"])


def queries() -> dict:
    return {"p1_found": p1_found, "p1_clean": p1_clean}


def oracle_sql() -> dict:
    return {}
