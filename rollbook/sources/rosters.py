"""Rosters in the headers of minutes, read line by line: what a line means follows from the lines before it.

Input are numbered lines (``minutes.headers``: id, line, text). A reader's
state is a running function of the lines: whether the block has begun or
ended, and which heading was last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rollbook.functions.dates import kanji_number
from rollbook.functions.text import SPACE, no_space

# The words that head and end a block, and the roles that may stand before a name (longer ones first) or head a list of members.
ATTENDING, AGENDA = "出席者は左のとおり", "本日の会議に付した案件"
INLINE_ROLES = ("委員長代理理事", "小委員長", "委員長", "理事", "幹事", "会長")
MEMBER_ROLES = ("委員", "理事", "幹事", "小委員")
MEMBER, PROPOSER, OTHERS = "委員", "発議者", "委員以外の議員"
ROLE_INDENT, NAME_INDENT = 4, 15  # full-width spaces before a role and, at least, before a member's name
WIDE = "　"


def _so_far() -> WindowSpec:
    return Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before() -> WindowSpec:
    return Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)


def _ever(c: Column, over: WindowSpec) -> Column:
    return F.coalesce(F.max(c).over(over), F.lit(False))


def _bare(lines: DataFrame) -> DataFrame:
    """Lines without white space at the end, their indent in full-width spaces and what stands after it."""
    text = F.regexp_replace("text", f"{SPACE}+$", "")
    cut = lines.withColumn("text", text).withColumn("body", F.regexp_replace("text", f"^{WIDE}+", ""))
    return cut.withColumn("indent", F.length("text") - F.length("body"))


def two_columned(lines: DataFrame) -> DataFrame:
    """id, line, pos, role and name of rosters with several members a line.

    The block begins after its heading and goes on as long as lines end in the
    honorific. A member ends with an honorific that white space or the line's
    end follows, so one inside a name does not part it; a role may stand before
    a name, with or without space, and is ``委員`` where there is none. A name
    is given without its spaces; an empty one tells of a line misread.
    """
    bare = _bare(lines)
    begun = bare.withColumn("_in", _ever(F.col("text").rlike(f"^{WIDE}出席(小)?委員$"), _before()))
    block = begun.withColumn("_out", _ever(F.col("_in") & ~F.col("text").endswith("君"), _so_far())).where("_in AND NOT _out")
    member = f"[ {WIDE}]*({'|'.join(INLINE_ROLES)})?[ {WIDE}]*(.*?)君(?=[ {WIDE}]|$)"
    roles, names = (F.regexp_extract_all("text", F.lit(member), i) for i in (1, 2))
    found = block.select("id", "line", F.posexplode(F.arrays_zip(roles.alias("role"), names.alias("name"))).alias("pos", "m"))
    return found.select("id", "line", "pos", F.when(F.col("m.role") == "", MEMBER).otherwise(F.col("m.role")).alias("role"), no_space(F.col("m.name")).alias("name"))


def indented(lines: DataFrame) -> DataFrame:
    """id, line, role and name of rosters with one member a line, whose role is told by indent and heading.

    Between the words that begin and end the list, a line that does not end in
    the honorific is a heading: at the indent of roles it names the role of the
    members below, at any other it heads people who are none. A line of rules
    changes nothing. A role and a name on one line end the heading above them.
    Under a role's heading only names at the members' indent count.
    """
    bare = _bare(lines).withColumn("_in", _ever(F.col("text").contains(ATTENDING), _before()))
    block = bare.withColumn("_out", _ever(F.col("_in") & F.col("text").contains(AGENDA), _so_far())).where("_in AND NOT _out AND body <> ''")
    named, at_role = F.col("text").endswith("君"), F.col("indent") == ROLE_INDENT
    inline = f"^(.+?){WIDE}{{2,}}(.+)君$"
    own = named & at_role & F.col("body").rlike(inline)
    heading = ~named & ~F.col("body").rlike("^[─―—-]+$")
    event = F.when(heading, F.struct(F.when(at_role, no_space(F.col("body"))).alias("role"))).when(own, F.struct(F.lit(None).cast("string").alias("role")))
    told = block.withColumns({"_own": own, "_last": F.last(event, ignorenulls=True).over(_so_far())})
    listed = named & ~at_role & (F.col("indent") >= NAME_INDENT) & F.coalesce(F.col("_last.role").isin(*MEMBER_ROLES), F.lit(False))
    role = F.when(F.col("_own"), no_space(F.regexp_extract("body", inline, 1))).when(listed, F.col("_last.role"))
    name = F.when(F.col("_own"), F.regexp_extract("body", inline, 2)).otherwise(F.regexp_replace("body", "君$", ""))
    return told.withColumn("role", role).where("role IS NOT NULL").select("id", "line", "role", no_space(name).alias("name"))


def rosters(lines: DataFrame, *, two_column_house: str = "衆議院") -> DataFrame:
    """Members of committees by the layout of their house: id, line, pos, role and name."""
    first = F.col("house") == two_column_house
    one = indented(lines.where(~first)).withColumn("pos", F.lit(0))
    return two_columned(lines.where(first)).unionByName(one)


def misread(members: DataFrame) -> DataFrame:
    """Rosters with a member without a name: entity and detail; their members are not to be used."""
    return members.where("name = ''").groupBy(F.col("id").alias("entity")).agg(F.concat(F.lit("no name in line "), F.min("line").cast("string")).alias("detail"))


def agendas(lines: DataFrame) -> DataFrame:
    """Proposers and bills of each header that has both: id, people (array of line and name) and bills (array of line, number and title).

    A header is before the list, in it, or at the agenda, which it never
    leaves. A proposer counts before any heading of the list and under that of
    members outside the committee. Only lines that bear on this are shuffled,
    once; a header's state and both its lists come from there.
    """
    text = F.regexp_replace("text", f"{SPACE}+$", "")
    bill = "^○(.+?)（参第([〇一二三四五六七八九十百]+)号）"
    heading = F.nullif(F.regexp_extract("text", f"^{WIDE}{{3}}([^{WIDE}\\s].*?)\\s*$", 1), F.lit(""))
    name = F.nullif(F.regexp_extract("text", f"^{WIDE}+{PROPOSER}{WIDE}+(.+?)君\\s*$", 1), F.lit(""))
    # what none of the patterns can fit is left out before any is tried
    c = F.col("text")
    likely = c.contains(ATTENDING) | c.contains(AGENDA) | c.contains(PROPOSER) | c.startswith("○") | (c.startswith(WIDE * 3) & ~c.startswith(WIDE * 4))
    cut = lines.where(likely).select("id", "line", text.alias("text")).select(
        "id", "line", F.col("text").contains(ATTENDING).alias("_begins"), F.col("text").contains(AGENDA).alias("_turns"), heading.alias("_heading"), no_space(name).alias("name"),
        F.when(F.col("text").rlike(bill), F.struct("line", kanji_number(F.regexp_extract("text", bill, 2)).alias("number"), F.trim(F.regexp_extract("text", bill, 1)).alias("title"))).alias("bill"))
    kept = cut.where(F.col("_begins") | F.col("_turns") | F.col("_heading").isNotNull() | F.col("name").isNotNull() | F.col("bill").isNotNull())
    told = kept.withColumn("_in", _ever(F.col("_begins"), _before())).withColumn("_agenda", _ever(F.col("_in") & F.col("_turns"), _so_far()))
    listed = F.col("_in") & ~F.col("_turns") & ~F.col("_agenda")
    held = told.withColumn("_section", F.last(F.when(listed, F.col("_heading")), ignorenulls=True).over(_so_far()))
    person = listed & F.col("name").isNotNull() & F.col("_heading").isNull() & (F.coalesce("_section", F.lit(OTHERS)) == OTHERS)
    both = held.groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(person, F.struct("line", "name")))).alias("people"), F.sort_array(F.collect_list(F.when(F.col("_in") & ~F.col("_turns") & F.col("_agenda"), F.col("bill")))).alias("bills"))
    return both.where("size(people) > 0 AND size(bills) > 0")


def proposers_and_bills(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposers among those attending, and members' bills on the agenda: (id, line, name) and (id, line, number, title). Headers that lack either have no rows (see ``agendas``)."""
    both = agendas(lines)
    return both.select("id", F.inline("people")), both.select("id", F.inline("bills"))
