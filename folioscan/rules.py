"""The rules for leftovers of machine-written text."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    number: str
    severity: str
    category: str
    pattern: str
    #: Lower-case texts of which a match holds one: a cheap test before the pattern.
    guards: tuple[str, ...]
    message: str
    #: Further texts of which a match holds one too; none: nothing more is asked.
    also: tuple[str, ...] = ()


#: A row's number, its end, and white space behind it.
_ROW_END = r"(?<!\d)\d++\s*+\\\\\s*+"
_RULE = r"\\\\\s*+(?:bottomrule|hline)"
#: Three rows of letters and numbers behind the head of a table; the third may be a rule. Gaps between the parts may hold anything. Taking the first of each part is
#: always enough, as whatever follows a later one follows the first too, so no part is given back (atomic groups): a table is read once, however many rows it has.
TABLE_ROWS = (
    r"(?sU)\\begin\s*\{tabular\}\s*\{[^}]*+\}\s*+[A-Za-z](?>.*?&)(?>.*?" + _ROW_END + r"[A-Za-z])(?>.*?&)(?>.*?" + _ROW_END + "(?=[A-Za-z]|" + _RULE + "))"
    r"(?:" + _RULE + r"|[A-Za-z](?>.*?&.*?\d+)|(?>.*?" + _ROW_END + _RULE + "))"
)
# The patterns decide what is found. (?iU): any case, Unicode classes; (?s): a dot is any character.
RULES = (
    Rule("R01", "error", "meta_comments", r"(?iU)here\s+is\s+(?:a|an)\s+(?:\d{1,4}[-\s]?(?:word|paragraph|sentence|page)\s+)?(?:summary|overview|outline|description|explanation|analysis)", ("here",), "Assistant meta-comment announcing a summary or the like", ("ummary", "overv", "outl", "cr", "explanat", "analy")),
    Rule("R02", "error", "meta_comments", r"(?iU)would\s+you\s+like\s+me\s+to\s+(?:make\s+(?:any\s+)?changes|(?:expand|elaborate|clarify|rewrite|continue|add|modify|adjust))", ("would",), "Assistant meta-comment offering further work"),
    Rule("R03", "error", "meta_comments", r"(?iU)I[',]?d\s+be\s+happy\s+to", ("happy",), "Assistant meta-comment: happy to help"),
    Rule("R04", "error", "meta_comments", r"(?iU)I[',]?d\s+be\s+glad\s+to", ("glad",), "Assistant meta-comment: glad to help"),
    Rule("R05", "error", "placeholder_data", r"(?iU)(?:fill|replace|populate|substitute)(?:\s+(?:it|them|this))?\s+in(?:\s+with)?(?:\s+the)?\s+(?:real|actual|proper|correct|your)\s+(?:data|numbers|values|results|content|information)", ("real", "actual", "proper", "correct", "your"), "Unfilled placeholder asking for real data"),
    Rule("R06", "error", "placeholder_data", r"(?iU)(?:this|the|these)\s+(?:data|table|figure|numbers|results|values)\s+(?:is|are)\s+illustrative", ("illu",), "Unfilled placeholder: content declared illustrative"),
    Rule("R07", "error", "placeholder_data", r"(?iU)(?:this|the)\s+(?:is\s+)?(?:a\s+)?(?:sample|draft|template|example)\s+(?:table|figure|section|paragraph|content)", ("ample", "draft", "template"), "Unfilled placeholder: sample or draft part"),
    Rule("R08", "error", "placeholder_data", r"(?iU)(?:insert|add|put)\s+(?:your\s+)?(?:content|text|data|information|details|description|results)\s+here", ("here",), "Unfilled placeholder: insert your content here", ("ert", "add", "put")),
    Rule("R09", "error", "placeholder_data", r"(?iU)(?:\[|\\\[)\s*(?:insert|add|put)\s+(?:figure|image|table|chart|graph|diagram|illustration|screenshot)\s*(?:here|above|below)?\s*(?:\]|\\\])", ("[",), "Unfilled placeholder for a figure or table"),
    Rule("R10", "error", "self_awareness", r"(?iU)as\s+an\s+AI\s+(?:language\s+)?(?:model|assistant)", ("model", "tant"), "Model self-reference: as an AI model"),
    Rule("R11", "error", "self_awareness", r"(?iU)I\s+(?:do\s+)?n[o']t\s+(?:have\s+access\s+to\s+(?:the\s+)?(?:internet|real[-\s]?time\s+(?:data|information)|specific\s+(?:data|information))|can(?:not)?\s+(?:access|retrieve|browse|look\s+up))", ("not", "n't"), "Model self-reference: no access to something", ("have", "can")),
    Rule("R12", "error", "self_awareness", r"(?iU)I\s+can[']?t\s+(?:provide|generate|create|write|help\s+with)", ("can",), "Model refusal: cannot provide something"),
    Rule("R13", "error", "self_awareness", r"(?iU)I[']?m\s+(?:sorry|afraid|unable)\s*,\s*(?:but\s+)?I", ("orry", "afraid", "unable"), "Model refusal: sorry, but"),
    Rule("R14", "error", "phantom_references", r"(?isU)\\caption\s*\{[^}]*(?:placeholder|draft|template|add\s+caption|caption\s+(?:text|here|goes\s+here)|your\s+caption\s+(?:here|text)|insert\s+caption|todo\s*:?\s*add\s+caption)[^}]*\}", ("\\caption",), "Phantom caption: placeholder text inside"),
    Rule("R15", "error", "phantom_references", r"(?iU)\\label\s*\{[^}]*(?:placeholder|draft|todo|fixme|xxx|replace)[^}]*\}", ("\\label",), "Phantom label: placeholder name", ("placeholder", "draft", "todo", "xme", "xxx", "replace")),
    Rule("R16", "warning", "latex_artifacts", r"(?iU)\\lipsum(?:\s*\[[^\]]*\])?", ("\\lip",), "Filler text left in: \\lipsum"),
    Rule("R17", "warning", "latex_artifacts", r"(?iU)\\blindtext(?:\s*\[\d+\])?", ("\\blindtext",), "Filler text left in: \\blindtext"),
    Rule("R18", "warning", "placeholder_data", r"(?iU)\bTODO\b\s*:?\s*(?:add|insert|write|fill|complete|update)", ("todo",), "Open TODO in the text"),
    Rule("R19", "warning", "placeholder_data", r"(?iU)\bFIXME\b", ("fixme",), "Open FIXME in the text"),
    Rule("R20", "warning", "latex_artifacts", TABLE_ROWS, ("{tabular}",), "Table with a few plain rows: perhaps only an illustration"),
)
#: Fixed value: caption texts that are placeholders.
PLACEHOLDER_CAPTION = r"(?iU)(?:placeholder|draft|template|add\s+caption|caption\s+(?:text|here|goes\s+here)|your\s+caption\s+(?:here|text)|insert\s+caption|todo\s*:?\s*add\s+caption|illustrative|sample\s+data|figure\s+\d+\s+about\s+here|table\s+\d+\s+about\s+here)"
