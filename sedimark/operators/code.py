"""Source code with braces: tokens, declarations with their scopes, complexity of methods, and references to names by context.

Files are (path, text). One pass of a pattern cuts a text into tokens; what a token belongs to is found by running counts and windows over the
tokens of its file: braces of one level open and close in turn, so the next one of a level closes a block, and the last one of the
level above holds a declaration. There is no parser; what cannot be told from neighbouring tokens is not told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.storage import staged

WORD = r"[\p{L}_][\p{L}\p{Nd}_]*+"
#: Comments, verbatim and plain strings, characters, words, numbers, signs of two characters, line ends, other signs.
TOKEN = (
    r"//[^\n]*+|/\*(?s:.*?)\*/|[$]?@\"(?:[^\"]++|\"\")*+\"|[$]?\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]|\\[^\n]{1,9}?)'|"
    + WORD
    + r"|[0-9][0-9A-Za-z_]*+|&&|\|\||=>|\?\?|\n|[^\s]"
)
TYPES = ("class", "interface", "struct", "enum", "record")
# Words that never name a member, and words before a name that make it no declaration.
NOT_NAMES = "if for foreach while switch catch using lock return nameof typeof sizeof default base this fixed checked unchecked when where get set init".split()
NOT_TYPES = "new return throw await else in is as yield goto case not and or do".split()


def tokens(files: DataFrame) -> DataFrame:
    """(path, pos, token, line, depth, parens): the tokens of every file without comments, with the braces and parentheses open before each.

    Texts are dealt by path and sorted before they are cut, so that windows over the tokens of a file neither move them nor find them out of order.
    """
    dealt = files.filter("text is not null").select("path", "text").repartition("path").sortWithinPartitions("path")
    cut = dealt.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)

    def open_before(a: str, b: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("token") == a, 1).when(F.col("token") == b, -1).otherwise(0)).over(before), F.lit(0)).cast("int")

    ends = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    placed = cut.withColumns({"line": (1 + F.coalesce(F.sum(ends).over(before), F.lit(0))).cast("int"), "depth": open_before("{", "}"), "parens": open_before("(", ")")})
    return placed.filter(~F.col("token").rlike(r"^(\n|//|/\*)"))


def _candidates(toks: DataFrame) -> DataFrame:
    """What may be a declaration, with neighbours, and what bounds one: braces, ends of statements and lists, names of namespaces.

    All other tokens end here. ``commas`` counts the commas of outer lists so far, ``space`` says that a namespace's name is still open, ``member``
    that the token can name a member. What a token is by itself is told before the windows, so that the code between windows stays small.
    """
    word = F.col("token").rlike(r"^[\p{L}_]")
    toks = toks.withColumns({
        "word": word, "nameable": word & (F.col("parens") == 0) & ~F.col("token").isin(NOT_NAMES + NOT_TYPES + list(TYPES)),
        "typing": (word | F.col("token").isin(">", "]", "?")) & ~F.col("token").isin(NOT_TYPES),
    })
    in_file = Window.partitionBy("path").orderBy("pos")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    comma = F.count_if((F.col("token") == ",") & (F.col("parens") == 1)).over(before)
    opened = F.last(F.when(F.col("token").isin("namespace", "{", ";"), F.col("token")), ignorenulls=True).over(before)
    near = {f"next{k}": F.lead("token", k).over(in_file) for k in (1, 2)} | {f"last{k}": F.lag("token", k).over(in_file) for k in (1, 2)}
    t = toks.withColumns(near | {"commas": comma, "opened": opened, "typed": F.lag("typing").over(in_file)})
    token, parens = F.col("token"), F.col("parens")
    bounds = token.isin("{", "}") | (token == ";") & (parens == 0) | (token == ")") & (parens == 1)
    space = F.coalesce(F.col("opened") == "namespace", F.lit(False)) | (token == "namespace")
    member = F.col("nameable") & F.coalesce("typed", F.lit(False)) & F.coalesce(F.col("next1").isin("(", "{", "=>", ";", "="), F.lit(False))
    kept = t.filter(bounds | space | member | F.col("word") & F.col("last1").isin(*TYPES))
    return kept.select("path", "pos", "token", "line", "depth", "parens", "next1", "next2", "last1", "last2", "word", "commas", space.alias("space"), member.alias("member"))


def _form(t: DataFrame) -> DataFrame:
    """Candidates with what each declares by its neighbours, if anything (``form``)."""
    is_type = F.col("word") & F.col("last1").isin(*TYPES) & ~F.coalesce(F.col("last2").isin(".", ":", ","), F.lit(False)) & ~F.col("token").isin(*TYPES)
    accessors = (F.col("next1") == "{") & F.col("next2").isin("get", "set", "init")
    form = (
        F.when((F.col("token") == "namespace") & ~F.coalesce(F.col("last1").isin(".", "@"), F.lit(False)), "namespace")
        .when(is_type, F.col("last1"))
        .when(F.col("member") & (F.col("next1") == "("), "method")
        .when(F.col("member") & (accessors | (F.col("next1") == "=>") & (F.col("last1") != ",")), "property")
        .when(F.col("member") & F.col("next1").isin(";", "="), "field")
    )
    return t.withColumn("form", form)


def _space_names(t: DataFrame) -> DataFrame:
    """(path, pos, space_name) of namespaces: the tokens up to a brace or a semicolon, one where neither comes within 32."""
    ahead = t.filter("space").withColumn("ahead", F.collect_list("token").over(Window.partitionBy("path").orderBy("pos").rowsBetween(1, 32))).filter("form = 'namespace'")
    stop = F.least(*(F.when(F.array_position("ahead", s) > 0, F.array_position("ahead", s)) for s in ("{", ";")))
    return ahead.select("path", "pos", F.array_join(F.slice("ahead", 1, F.greatest(F.coalesce(stop, F.lit(2)) - 1, F.lit(1))), "").alias("space_name"))


def declarations(files: DataFrame) -> DataFrame:
    """(path, pos, kind, name, line, end_line, parameters, container, container_kind, namespace), one row a declaration.

    Kinds are namespace, type keywords, method, constructor, property and field. The container is the innermost declaration whose braces
    hold it; parameters are counted by the commas of their list, generic arguments included.
    """
    t = _form(staged(_candidates(tokens(files)), "code-tokens"))
    in_file = Window.partitionBy("path").orderBy("pos")
    # The list after a name is an outer one; it ends with the first sign that closes one.
    shut = F.when((F.col("token") == ")") & (F.col("parens") == 1), F.struct("next1", "commas"))
    closing = F.last(shut, ignorenulls=True).over(Window.partitionBy("path").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1))
    names = _space_names(t).select("path", "pos", "space_name", F.lit(True).alias("named"))
    t = t.withColumn("closing", F.when(F.col("form") == "method", closing)).filter("form is not null or token in ('{', '}') or token = ';' and parens = 0")
    t = t.unionByName(names, allowMissingColumns=True)
    t = t.withColumn("space_name", F.lag("space_name").over(Window.partitionBy("path").orderBy("pos", F.col("named").isNull()))).filter("named is null")
    kind = F.when((F.col("form") != "method") | F.col("closing.next1").isin("{", "=>", ";", ":", "where"), F.col("form"))
    name = F.when(kind == "namespace", F.col("space_name")).otherwise(F.col("token"))
    n_parameters = F.when(kind == "method", F.when(F.col("next2") == ")", 0).otherwise(F.col("closing.commas") - F.col("commas") + 1)).cast("int")
    t = t.withColumns({"kind": kind, "name": F.when(kind.isNotNull(), name), "parameters": n_parameters})
    # The declaration that a brace opens: the last one of its level with no end of a statement or block between.
    own = F.when(F.col("kind").isNotNull() & (F.col("kind") != "field"), F.struct(F.col("pos").alias("pos"), F.col("kind").alias("kind"), F.col("name").alias("name"), F.lit(True).alias("real")))
    none = F.struct(F.lit(-1).alias("pos"), F.lit("").alias("kind"), F.lit("").alias("name"), F.lit(False).alias("real"))
    level = F.col("depth") - F.when(F.col("token") == "}", 1).otherwise(0)
    mark = F.when(F.col("kind").isNotNull() & (F.col("kind") != "field"), own).when(F.col("token").isin("{", "}") | (F.col("token") == ";") & (F.col("parens") == 0), none)
    at_level = Window.partitionBy("path", "level").orderBy("pos")
    t = t.withColumns({"level": level, "mark": mark})
    opener = F.when(F.col("token") == "{", F.last("mark", ignorenulls=True).over(at_level.rowsBetween(Window.unboundedPreceding, -1)))
    braces = t.withColumn("opener", opener).filter("kind is not null or token in ('{', '}')")
    # Braces of one level open and close in turn; declarations stand apart.
    pair = Window.partitionBy("path", "level", F.col("token").isin("{", "}")).orderBy("pos")
    braces = braces.withColumns({"block_end": F.when(F.col("token") == "{", F.lead("pos").over(pair)), "block_end_line": F.when(F.col("token") == "{", F.lead("line").over(pair))})
    t = staged(braces.select("path", "pos", "token", "kind", "name", "line", "depth", "parameters", "block_end", "block_end_line", "opener"), "code-blocks")
    blocks = t.filter("token = '{'").select("path", "pos", (F.col("depth") + 1).alias("level"), F.col("opener").alias("holder"))
    inner = t.filter("kind is not null").select("path", "pos", F.col("depth").alias("level"), "kind", "name", "line", "parameters")
    held = blocks.unionByName(inner, allowMissingColumns=True).withColumn("held", F.last("holder", ignorenulls=True).over(at_level.rowsBetween(Window.unboundedPreceding, -1))).filter("kind is not null")
    ends = t.filter("token = '{' and opener.real").select("path", F.col("opener.pos").alias("pos"), "block_end", "block_end_line").groupBy("path", "pos").agg(F.min_by("block_end_line", "block_end").alias("end_line"), F.min("block_end").alias("end_pos"))
    found = held.join(ends, ["path", "pos"], "left")
    real = F.coalesce(F.col("held.real"), F.lit(False)) & (F.col("level") > 0)
    spaces = F.when(F.col("kind") == "namespace", F.struct("name", F.coalesce("end_pos", F.lit(1 << 30)).alias("until")))
    last_space = F.last(spaces, ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumns({"container": F.when(real, F.col("held.name")), "container_kind": F.when(real, F.col("held.kind")), "space": last_space})
    found = found.withColumn("namespace", F.when(F.col("space.until") > F.col("pos"), F.col("space.name")))
    in_type = F.col("container_kind").isin(*TYPES)
    found = found.filter((F.col("kind") != "field") | in_type)
    made = F.when((F.col("kind") == "method") & in_type & (F.col("name") == F.col("container")), "constructor").otherwise(F.col("kind"))
    return found.withColumn("kind", made).select(
        "path", "pos", "kind", "name", "line", F.coalesce("end_line", "line").alias("end_line"), "parameters", "container", "container_kind", "namespace"
    )


# Frames of the fold below: plain braces, else, if, loops and switch, try and its parts, do; ten more for a statement without braces.
_PLAIN, _ELSE, _IF, _LOOP, _TRY, _DO = range(6)
_BARE, _PAREN = 10, 100
#: The tokens that the fold's state depends on; what stands between them matters only as what follows one.
FOLDED = "{ } ( ) ; if else for foreach switch while do try catch finally case && ||".split()


def nesting_fold(words: Column) -> Column:
    """Struct (cognitive, nesting, cyclomatic) of an array of tokens, by a fold whose state is the stack of what is open.

    ``if``, loops and ``switch`` cost one and one more for each of them around; ``catch`` costs one. Nesting counts those, ``else`` and the parts of
    ``try``; the statement after ``else`` is one deeper. The cyclomatic number counts branches, loops, cases, handlers, ``&&`` and ``||``.
    """
    steps = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.struct(a.alias("t"), b.alias("next")))
    steps = F.filter(steps, lambda x: x["t"].isin(FOLDED))
    start = F.struct(
        F.array().cast("array<int>").alias("stack"), F.lit(0).alias("pending"), F.lit(0).alias("parens"), F.lit(False).alias("after_do"),
        F.lit(0).alias("cognitive"), F.lit(0).alias("nesting"), F.lit(1).alias("cyclomatic"),
    )

    def frames(stack: Column, *kinds: int) -> Column:
        return F.size(F.filter(stack, lambda f: (f % _BARE).isin(*kinds)))

    def top(stack: Column) -> Column:
        return F.try_element_at(stack, F.lit(-1))

    def pop(stack: Column) -> Column:
        return F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))

    def bare(f: Column) -> Column:
        return F.coalesce((f % _PAREN) >= _BARE, F.lit(False))

    def ended(stack: Column, following: Column) -> Column:
        """The stack once a statement has ended: frames without braces go, up to an ``if`` that goes on with ``else`` or a ``do`` with ``while``."""
        walk = F.aggregate(
            F.reverse(stack),
            F.struct(F.lit(0).alias("gone"), F.lit(True).alias("on"), F.lit(False).alias("do")),
            lambda s, f: F.when(
                s["on"] & bare(f),
                F.struct(
                    (s["gone"] + 1).alias("gone"),
                    (~((following == "else") & (f % _BARE == _IF)) & ~((following == "while") & (f % _BARE == _DO))).alias("on"),
                    ((following == "while") & (f % _BARE == _DO)).alias("do"),
                ),
            ).otherwise(F.struct(s["gone"].alias("gone"), F.lit(False).alias("on"), s["do"].alias("do"))),
        )
        return F.get(F.transform(F.array(walk), lambda w: F.struct(F.slice(stack, 1, F.size(stack) - w["gone"]).alias("stack"), w["do"].alias("do"))), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        t, following = x["t"], F.coalesce(x["next"], F.lit(""))
        loops = t.isin("for", "foreach", "switch") | (t == "while") & ~s["after_do"]
        counts = (t == "if") | loops
        code = F.when(t == "if", _IF).when(loops, _LOOP).when(t == "else", _ELSE).when(t.isin("try", "catch", "finally"), _TRY).when(t == "do", _DO)
        short = t.isin("else", "do") & (following != "{")
        shut = (t == ")") & (s["parens"] == 1)
        headless = shut & s["pending"].isin(_IF, _LOOP) & (following != "{")
        opens = (t == "{") & (s["parens"] == 0)
        frame = F.when(t == "{", F.when(opens, s["pending"]).otherwise(_PLAIN) + _PAREN * s["parens"])
        frame = frame.when(short, code + _BARE).when(headless, s["pending"] + _BARE)
        closed = top(s["stack"])
        closing = t == "}"
        goes_on = ((closed % _BARE == _IF) & (following == "else")) | ((closed % _BARE == _TRY) & following.isin("catch", "finally")) | ((closed % _BARE == _DO) & (following == "while"))
        done = closing & F.coalesce((closed % _BARE > 0) & ~goes_on, F.lit(False)) | (t == ";") & (s["parens"] == 0)
        base = F.when(closing, pop(s["stack"])).otherwise(s["stack"])
        after = F.when(done, ended(base, following)).otherwise(F.struct(base.alias("stack"), F.lit(False).alias("do")))
        stack = F.when(frame.isNotNull(), F.concat(s["stack"], F.array(frame))).otherwise(after["stack"])
        do_next = F.coalesce(after["do"] | closing & (closed % _BARE == _DO) & (following == "while"), F.lit(False))
        parens = F.when(t == "(", s["parens"] + 1).when(t == ")", F.greatest(s["parens"] - 1, F.lit(0))).when(t == "{", F.lit(0)).when(closing, F.coalesce(F.floor(closed / _PAREN).cast("int"), F.lit(0))).otherwise(s["parens"])
        pending = F.when(code.isNotNull() & ~short, code).when(opens | headless | (t == ";") & (s["parens"] == 0), F.lit(0)).otherwise(s["pending"])
        cost = F.when(counts, 1 + frames(s["stack"], _IF, _LOOP)).when(t == "catch", F.lit(1)).otherwise(0)
        branch = t.isin("if", "while", "for", "foreach", "case", "catch", "&&", "||").cast("int")
        return F.struct(
            stack.alias("stack"), pending.alias("pending"), parens.alias("parens"), do_next.alias("after_do"),
            (s["cognitive"] + cost).alias("cognitive"), F.greatest(s["nesting"], frames(stack, _ELSE, _IF, _LOOP, _TRY)).alias("nesting"), (s["cyclomatic"] + branch).alias("cyclomatic"),
        )

    return F.aggregate(steps, start, step, lambda s: F.struct(s["cognitive"].alias("cognitive"), s["nesting"].alias("nesting"), s["cyclomatic"].alias("cyclomatic")))


def method_complexity(files: DataFrame) -> DataFrame:
    """(path, container, name, line, parameters, cyclomatic, cognitive, nesting, overall) of every method; 1, 0 and 0 without a body.

    ``overall`` weighs the cyclomatic number by 0.4, the cognitive by 0.3, nesting by 0.2 and parameters by 0.1.
    """
    found = staged(declarations(files).filter("kind in ('method', 'constructor')"), "code-methods")
    marks = found.select("path", "pos", F.col("pos").alias("method"), "end_line")
    both = tokens(files).select("path", "pos", "token", "line").unionByName(marks, allowMissingColumns=True)
    last = F.last(F.when(F.col("method").isNotNull(), F.struct("method", "end_line")), ignorenulls=True).over(Window.partitionBy("path").orderBy("pos", F.col("method").isNull()))
    own = both.withColumn("own", last).filter("method is null and line <= own.end_line")
    bodies = own.groupBy("path", F.col("own.method").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("words"))
    folded = found.join(bodies, ["path", "pos"]).withColumn("m", nesting_fold(F.col("words")))
    overall = 0.4 * F.col("m.cyclomatic") + 0.3 * F.col("m.cognitive") + 0.2 * F.col("m.nesting") + 0.1 * F.col("parameters")
    return folded.select("path", "container", "name", "line", "parameters", "m.cyclomatic", "m.cognitive", "m.nesting", F.round(overall, 6).alias("overall"))


def text_references(files: DataFrame, names: DataFrame) -> DataFrame:
    """(name, path, line_no): lines that refer to one of ``names`` (name) as a whole word in a context that a reference has.

    The words of all lines are cut out once with what stands beside them and joined with all names, so the work does not grow with
    names times patterns; files are dealt by path first, however few parts they come in, and names meet words by shuffle, as they grow with the
    files and a broadcast would pass them all through the driver. Comment lines and ``using`` and ``namespace`` lines do not count. A context is a following space, ``;`` or ``=``; a
    space before and one of ``{[(.=,`` after; or ``.``, ``: `` or ``, `` before.
    """
    dealt = files.filter("text is not null").select("path", "text").repartition("path")
    lines = dealt.select("path", F.posexplode(F.split("text", "\n", -1)).alias("no", "raw"))
    lines = lines.select("path", (F.col("no") + 1).alias("line_no"), F.trim("raw").alias("line")).filter(~F.col("line").rlike("^(//|using |namespace )"))
    parts = F.regexp_extract_all("line", F.lit(rf"{WORD}|[0-9][\p{{L}}\p{{Nd}}_]*+|[^\p{{L}}\p{{Nd}}_]++"), F.lit(0))
    cut = lines.select("path", "line_no", parts.alias("parts"))
    beside = F.transform("parts", lambda w, i: F.struct(w.alias("name"), F.when(i > 0, F.right(F.get("parts", i - 1), F.lit(2))).otherwise("").alias("left"), F.coalesce(F.left(F.get("parts", i + 1), F.lit(1)), F.lit("")).alias("right")))

    def fits(w: Column) -> Column:
        left, right = w["left"], w["right"]
        return right.isin(" ", ";", "=") | left.endswith(" ") & right.isin(*"{[(.,") | left.endswith(".") | left.isin(": ", ", ")

    met = F.array_distinct(F.transform(F.filter(beside, fits), lambda w: w["name"]))
    each = cut.select("path", "line_no", F.explode(met).alias("name"))
    return each.join(names.select("name").distinct().hint("merge"), "name").select("name", "path", "line_no").distinct()
