"""Parameters of the ingest, registry and search jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

# The four searched fields and their boosts.
FIELD_BOOSTS = {
    "content.raw": 3.0,
    "content": 2.0,
    "content.folded": 1.0,
    "filename": 2.0,
}

# Document states.
STATUSES = ("pending", "extracted", "indexed", "needs_ocr", "error")

# Czech stop words of the content analyser.
CZECH_STOPWORDS = (
    "a s k o i u v z dnes cz tímto budeš budem byli jseš můj svým ta tomto tohle tuto tyto jej "
    "zda proč máte tato kam tohoto kdo kteří mi nám tom tomuto mít nic proto kterou byla toho "
    "protože asi ho naši napište re což tím takže svých její svými jste aj tu tedy teto bylo kde "
    "ke pravé ji nad nejsou či pod téma mezi přes ty pak vám ani když však neg jsem tento článku "
    "články aby jsme před pta jejich byl ještě až bez také pouze první vaše která nás nový tipy "
    "pokud může strana jeho své jiné zprávy nové není vás jen podle zde už být více bude již než "
    "který by které co nebo ten tak má při od po jsou jak další ale si se ve to jako za zpět ze "
    "do pro je na atd atp jakmile přičemž já on ona ono oni ony my vy jí ji mě mne jemu tomu těm "
    "těmu němu němuž jehož jíž jelikož jež jakož načež"
).split()


@dataclass(frozen=True)
class Settings:
    """One value object for everything a caller may tune."""

    bucket: str = "documents"
    raw_prefix: str = "documents/"
    text_prefix: str = "text/"
    min_chars_per_page: float = 100.0
    max_message_chars: int = 500
    keyword_max_chars: int = 512
    sweep_seconds: int = 60

    page_size: int = 20
    max_page_size: int = 100

    k1: float = 1.2
    b: float = 0.75
    field_boosts: dict[str, float] = field(default_factory=lambda: dict(FIELD_BOOSTS))
    stopwords: tuple[str, ...] = tuple(CZECH_STOPWORDS)
    fuzzy: bool = True
    max_expansions: int = 50

    fragment_chars: int = 200
    max_fragments: int = 3
    mark_open: str = "<em>"
    mark_close: str = "</em>"

    # Scale switches: a history slot holds at most this many updates, a frame is
    # broadcast only up to this many rows, and a join beyond that is salted.
    slot_rows: int = 1_000_000
    broadcast_rows: int = 500_000
    salts: int = 32
    rows_per_task: int = 1_000_000
    target_partition_bytes: int = 1 << 30
    # Text whose words a task groups, and whose postings a task sorts, in memory.
    text_bytes: int = 2 << 20
    sorted_text_bytes: int = 32 << 20
    # A search that meets more postings than this leaves out those that no hit needs.
    prune_rows: int = 1_000_000_000


DEFAULTS = Settings()
