"""Caption texts: notices, roster labels and other chrome told from speech, and speaker lines parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Fragments of system notices.
NOTICE_FRAGMENTS = (
    "se unió a la reunión", "se unio a la reunion", "se unió a la llamada", "se unio a la llamada",
    "se ha unido a la reunión", "se ha unido a la reunion", "se ha unido a la llamada",
    "joined the meeting", "joined the call",
    "abandonó la reunión", "abandono la reunion", "abandonó la llamada", "abandono la llamada",
    "salió de la reunión", "salio de la reunion", "salió de la llamada", "salio de la llamada",
    "left the meeting", "left the call",
    "micrófono está desactivado", "microfono esta desactivado", "micrófono está silenciado", "microfono esta silenciado",
    "your microphone is muted", "your microphone is off",
    "cámara está desactivada", "camara esta desactivada", "your camera is off",
    "desconocido externo", "unknown external",
    "grabación ha comenzado", "grabacion ha comenzado", "grabación iniciada", "grabacion iniciada",
    "recording has started", "recording started", "started recording this meeting",
    "compartió pantalla", "compartio pantalla", "está compartiendo su pantalla", "esta compartiendo su pantalla",
    "shared their screen", "is sharing their screen", "started sharing their screen",
)
NOTICE_WORDS = 12
#: Starts of transient notices.
NOTICE_PREFIXES = (
    "compartió pantalla", "compartio pantalla", "ha compartido pantalla", "shared their screen",
    "el zoom se restableció", "el zoom se restablecio", "zoom reset",
    "se ha iniciado el cierre del título", "se ha iniciado el cierre del titulo", "closed captions started",
)
#: Words of a meeting's controls and their weights.
SURFACE_WEIGHTS = (
    (3, "Leave|Salir|Abandonar|Colgar"),
    (2, "Share content|Compartir contenido|Presentar"),
    (2, "Raise your hand|Levantar la mano"),
    (2, "Open audio options|Opciones de audio|Mute mic|Silenciar|Unmute|Reactivar audio"),
    (2, "Open video options|Opciones de video|Turn camera on|Activar c[aá]mara|Camera|C[aá]mara"),
    (1, "People|Personas|Participants|Participantes|React|Reaccionar|Rooms|Salas|Notes|Notas"),
)
SURFACE_LEAST = 5
#: Starts of lines that belong to the caption controls.
CAPTION_UI = (
    "Captions will be shown|Live Caption,|Closed captions|Hide live captions|Caption Settings|Open captions|"
    "Live captions language|Speaker attribution|Turn off live captions|Show captions|Subtitles|More options"
)
#: The application whose windows are read, the default title, and the names of its own surfaces.
APPLICATION = "Microsoft Teams"
DEFAULT_TITLE = "Meeting with Microsoft Teams"
SURFACE_TITLES = (
    "Calendar", "Calendario", "Chat", "Planner", "Activity", "Actividad", "Files", "Archivos", "Teams", "Apps", "Aplicaciones", "Store", "Tienda", "Calls", "Llamadas", "Help", "Ayuda", "Tasks", "Tareas",
    "OneNote", "Shifts", "Turnos", "Wiki", "Viva", "Approvals", "Aprobaciones", "Bookings", "Lists", "Listas", "Whiteboard", "Pizarra", "Home", "Inicio",
)
#: Titles of windows of the application that hold no meeting, and first words of its technical windows.
APP_SURFACES = (
    "Activity", "Calendar", "Chat", "Chats", "Teams", "Calls", "Files", "OneDrive", "Apps", "Copilot", "People", "Meet", "Search", "Settings", "Help", "Assignments", "Viva Engage", "Runtime Broker", "Microsoft Teams",
)
TECHNICAL = r"^(Subframe|Utility|Manager|GPU Process|Crashpad)\b"
#: Forms of 'Name (Org)' and 'Name (Org) text'.
SPEAKER_LINE = r"^([^,;:!?()]{2,90})\s+\(([^)]+)\)$"
INLINE = r"^(.+?\([^)]+\))\s+(.+)$"
#: What no organisation holds, and starts that no name has.
NOT_ORG = r"Ctrl|Alt|Shift|\+|You|more tabs|participants?"
NOT_NAME = "Meeting with|Chat|Chats|New message|Teams|General|All Company|Shared|Join|See more|Type a message"
#: Lines of the application's frame, by their start or by what follows a name and a colon.
FRAME_STARTS = (
    r"New message|Chats? \(|More filters|Copilot|Quick views|Mentions|Discover|Drafts|Favorites|Teams and channels|Chat participants|Shared$|[0-9]+ more tabs\.|Add a tab|Join$|"
    "View and add participants|Find in chat|Open chat details|More chat options|Type a message|See more|See all your teams|Communities|Join communities|Resize left panel|Meeting ended|Meeting started"
)
FRAME_EVENTS = r"joined the conversation\.|named the meeting|Chat has been turned on|Meeting ended:|[0-9]{1,2}:[0-9]{2}\s*(AM|PM).*(Meeting ended|Meeting started)"
#: Marks before and after the captions of a snapshot, and controls among them.
CAPTIONS_START = "^(Invite people to join you|Live Captions)$"
CAPTIONS_END = "Closed captions overflow menu|Hide live captions|More options|Calling controls"
CONTROLS = (
    "Settings and more|Calling indicators|Encryption status|Elapsed time|Meeting controls|Chat|People|Raise your hand|React|View|More|Turn camera|Open video|Open audio|Mute mic|Share content|Leave|"
    "Shared content view|Invite people to join you|Live Captions"
)
#: Weights of what speaks for a root that holds captions (lower is better).
ROOT_MARKS = (("meeting_chrome", -50), ("caption_chrome", -20), ("captions_window", -15), ("chat_surface", 1000), ("call_window", -5), ("on_screen", -2))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_notice(c: Column | str) -> Column:
    """Blank, or at most 12 words with a notice fragment in it, case aside."""
    low = F.lower(tx.strip(F.coalesce(_col(c), F.lit(""))))
    short = F.size(F.filter(F.split(low, " "), lambda w: w != "")) <= NOTICE_WORDS
    return (low == "") | (short & F.exists(F.lit(list(NOTICE_FRAGMENTS)), lambda f: F.contains(low, f)))


def is_roster_label(c: Column | str) -> Column:
    """Two to four words in capitals, one of four letters or more, without sentence punctuation."""
    text = tx.strip(_col(c))
    parts = F.filter(F.split(text, " "), lambda w: w != "")
    letters = lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", ""))
    return ~text.rlike(r"[.,?!:;]") & text.rlike(r"\p{L}") & ~text.rlike(r"\p{Ll}") & F.size(parts).between(2, 4) & F.exists(parts, lambda w: letters(w) >= 4)


def is_chrome(speaker: Column | str, text: Column | str) -> Column:
    same = F.lower(tx.strip(_col(text))) == F.lower(tx.strip(_col(speaker)))
    return is_notice(text) | F.coalesce(same, F.lit(False)) | is_roster_label(text)


def is_blocked(c: Column | str) -> Column:
    low = F.lower(tx.strip(_col(c)))
    return F.exists(F.lit(list(NOTICE_PREFIXES)), lambda p: F.startswith(low, p))


def is_caption_ui(c: Column | str) -> Column:
    return (tx.strip(_col(c)) == "") | _col(c).rlike(f"(?i)^({CAPTION_UI})")


def is_frame_line(c: Column | str) -> Column:
    """Whether a line belongs to the application's frame."""
    return (tx.strip(_col(c)) != "") & (_col(c).rlike(f"(?i)^({FRAME_STARTS})") | _col(c).rlike(rf"(?i)^.+:\s*({FRAME_EVENTS})"))


def is_speaker_line(c: Column | str) -> Column:
    """'Name (Org)' with a name of two words or more, and neither of the frame."""
    name, org = F.regexp_extract(_col(c), SPEAKER_LINE, 1), F.regexp_extract(_col(c), SPEAKER_LINE, 2)
    frame = is_frame_line(tx.strip(_col(c))) | org.rlike(f"(?i){NOT_ORG}") | tx.strip(name).rlike(f"(?i)^({NOT_NAME})")
    return _col(c).rlike(SPEAKER_LINE) & F.contains(tx.strip(name), F.lit(" ")) & ~frame


def reads_as_caption(c: Column | str) -> Column:
    """Whether a chunk is a speaker line, or begins with one."""
    line = tx.strip(_col(c))
    return is_speaker_line(line) | is_speaker_line(F.regexp_extract(line, INLINE, 1))


def surface_score(c: Column | str) -> Column:
    out = F.lit(0)
    for weight, pattern in SURFACE_WEIGHTS:
        out = out + F.when(_col(c).rlike(rf"(?iu)\b({pattern})\b"), weight).otherwise(0)
    return out


def is_meeting_surface(c: Column | str) -> Column:
    return surface_score(c) >= SURFACE_LEAST


def root_order(candidates: DataFrame, marks: tuple[tuple[str, int], ...] = ROOT_MARKS) -> DataFrame:
    """Candidates (ord, and a boolean column for each mark) by the sum of the marks that hold, lowest first, with score."""
    score = F.lit(0)
    for column, weight in marks:
        score = score + F.when(F.col(column), weight).otherwise(0)
    return candidates.withColumn("score", score).orderBy("score", "ord")


def window_priority(c: Column | str, application: str = APPLICATION) -> Column:
    """0 for a meeting's window, 1 for calls and captions, 2 for chats that may be one, -1 for others."""
    name = F.coalesce(_col(c), F.lit(""))
    like = lambda pattern, text=name: text.rlike(f"(?iu){pattern}")
    bare = F.regexp_replace(tx.strip(name), r"(?iu)^WebView2:\s*", "")
    title = bare
    for pattern in (r"^Chat\s*\|\s*", r"^(Captions|Subt[ií]tulos)\s*\|\s*", rf"\s*\|\s*{application}$"):
        title = F.regexp_replace(title, f"(?iu){pattern}", "")
    title = tx.strip(title)
    call = like(rf"^WebView2:\s*.+\|\s*{application}$") & (F.lower(title) != application.lower()) & ~like(TECHNICAL, title)
    return (
        F.when(tx.strip(name) == "", -1).when(like(r"^Chat\s*\|", bare), -1).when(call, 0).when(F.lower(title).isin(*(x.lower() for x in APP_SURFACES)), -1).when(like(rf"^(?!Chat \|).+\|\s*{application}$"), 0)
        .when(like(rf"{application} Meeting|Reuni[oó]n|Llamada|Call"), 1).when(like("Meeting with"), 2).when(like(r"^(Captions|Subt[ií]tulos)\s*\|", bare), 1).otherwise(-1)
    )


def windows_in_order(windows: DataFrame) -> DataFrame:
    """Windows (name, used_at) that may hold a meeting, by priority and then last use."""
    return windows.withColumn("priority", window_priority("name")).filter("priority >= 0").orderBy("priority", F.col("used_at").desc())


def clean_title(c: Column | str, application: str = APPLICATION) -> Column:
    """A window title without the application's prefixes, counter and suffix; null where nothing, the application's name, a technical window or a surface is left."""
    out = tx.strip(_col(c))
    for pattern in (r"^WebView2:\s*", r"^Chat\s*\|\s*", r"^(Captions|Subt[ií]tulos)\s*\|\s*", rf"^{application} \(PWA\)\s*-\s*", r"^\(\d+\)\s*", rf"\s*\|\s*{application}$"):
        out = F.regexp_replace(out, f"(?iu){pattern}", "")
    out = tx.strip(out)
    return F.when((out != "") & (F.lower(out) != application.lower()) & ~out.rlike(f"(?iu){TECHNICAL}") & ~is_surface_title(out), out)


def is_surface_title(c: Column) -> Column:
    """Whether a title, or what stands before its first bar, is one of the application's own surfaces."""
    return F.lower(tx.strip(F.substring_index(c, "|", 1))).isin(*(s.lower() for s in SURFACE_TITLES))


def replaces_title(current: Column, new: Column, default: str = DEFAULT_TITLE) -> Column:
    """Whether a newly seen title is better: the current one is blank, the default, or 'Meeting with ...' where the new one isn't."""
    generic = (F.coalesce(tx.strip(current), F.lit("")) == "") | (F.lower(current) == default.lower())
    with_ = lambda c: F.startswith(F.lower(c), F.lit("meeting with "))
    return F.coalesce(F.lower(current) != F.lower(new), F.lit(True)) & (generic | (with_(current) & ~with_(new)))


def candidate_lines(snapshots: DataFrame) -> DataFrame:
    """Lines (snapshot_id, line_no, line) that may be captions.

    They follow the last start mark, or without one begin at the first speaker line; they end before the first
    end mark or frame line after that. Snapshots with neither have none; controls and bare clock times go.
    """
    last_mark = F.max(F.when(F.col("line").rlike(CAPTIONS_START), F.col("line_no")))
    first_speaker = F.min(F.when(is_speaker_line("line"), F.col("line_no")))
    starts = snapshots.groupBy("snapshot_id").agg(F.coalesce(last_mark, first_speaker - 1).alias("_from")).filter("_from IS NOT NULL")
    rows = snapshots.join(starts, "snapshot_id").filter(F.col("line_no") > F.col("_from"))
    is_end = F.col("line").rlike(f"(?i){CAPTIONS_END}") | is_frame_line("line")
    ends = rows.groupBy("snapshot_id").agg(F.min(F.when(is_end, F.col("line_no"))).alias("_to"))
    inside = rows.join(ends, "snapshot_id").filter(F.col("_to").isNull() | (F.col("line_no") < F.col("_to")))
    return inside.filter(~F.col("line").rlike(f"(?i)^({CONTROLS})$") & ~F.col("line").rlike(r"^\d{1,2}:\d{2}$")).select("snapshot_id", "line_no", "line")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Captions (snapshot_id, line_no, speaker, text) of candidate lines.

    A speaker line names the speaker of the lines after it; 'Name (Org) text' has a speaker of its own. Control
    lines go; without a speaker line before, the speaker is empty.
    """
    rows = lines.filter(~is_caption_ui("line")).withColumn("_line", tx.strip("line"))
    inline = F.col("_line").rlike(INLINE)
    w = Window.partitionBy("snapshot_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_head", F.when(is_speaker_line("line"), F.col("_line"))).withColumn("_now", F.last("_head", ignorenulls=True).over(w)).filter("_head IS NULL")
    own = tx.strip(F.regexp_extract("_line", INLINE, 1))
    out = rows.withColumn("speaker", F.when(inline, own).otherwise(F.coalesce("_now", F.lit("")))).withColumn("text", F.when(inline, tx.strip(F.regexp_extract("_line", INLINE, 2))).otherwise(F.col("_line")))
    return out.filter(tx.strip("text") != "").drop("_line", "_head", "_now")


def new_lines(snapshots: DataFrame) -> DataFrame:
    """Rows (poll, speaker, text, pos) of each poll that the poll before it didn't have."""
    before = snapshots.select((F.col("poll") + 1).alias("poll"), "speaker", "text")
    return snapshots.join(before, [snapshots.poll == before.poll, snapshots.speaker.eqNullSafe(before.speaker), snapshots.text.eqNullSafe(before.text)], "left_anti")
