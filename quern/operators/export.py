"""Exports of a report: JSON, and a workbook of three sheets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import formula_guard
from ..sources.xlsx import write_workbook
from .filters import Request

#: Headers and labels of the workbook.
SUMMARY_HEAD, QUESTION_HEAD, THEME_HEAD = ["Alan", "Değer"], ["Kimlik", "Soru", "Adet", "Oran (%)", "Örnek mesajlar (redakte)"], ["Kimlik", "Tema", "Adet", "Oran (%)", "İlgili soru kimlikleri"]
ABOUT = {"analysis_id": "Analiz kimliği", "generated_at": "Oluşturulma", "filename": "Dosya", "sheet_name": "Sayfa"}
MODES = ("Bağımsız mesajlar", "Session bağlamlı kullanıcı turn'leri")
USED = {"model": "Model", "prompt_version": "Prompt sürümü", "prompt_hash": "Prompt özeti"}
TOKENS = {"prompt_tokens": "Prompt token", "completion_tokens": "Yanıt token", "cached_tokens": "Cache'den okunan token", "cache_write_tokens": "Cache'e yazılan token", "total_tokens": "Toplam token"}
COST_SOURCES = {"provider": "OpenRouter usage.cost", "snapshot": "Fiyat snapshot hesabı"}
CONVERSATION = {
    "session": "Session kolonu",
    "order": "Mesaj sıra kolonu",
    "role": "Rol kolonu",
    "message_type": "Mesaj türü kolonu",
    "user_roles": "Kullanıcı rol değerleri",
    "assistant_roles": "Bot rol değerleri",
    "target_types": "Hedef mesaj türleri",
    "context_types": "Bağlam mesaj türleri",
    "max_turns": "Azami geçmiş turn",
    "max_tokens": "Azami bağlam token",
}
PRICES = {"input": "Girdi fiyatı (USD / 1M)", "output": "Çıktı fiyatı (USD / 1M)", "cache_read": "Cache okuma fiyatı (USD / 1M)", "cache_write": "Cache yazma fiyatı (USD / 1M)"}
NONE = "Yok"
WARNING_HEAD = ("Uyarı kodu", "Açıklama")
MESSAGES = {
    "LLM_UNKNOWN_RECORD_ID": "Model {n} adet geçersiz kayıt kimliği döndürdü; bu eşlemeler yok sayıldı.",
    "LLM_DUPLICATE_ASSIGNMENT": "Model {n} kaydı birden fazla kategoriye eşledi; yalnızca ilk eşleme kullanıldı.",
    "LLM_UNASSIGNED_RECORDS": "Model {n} kaydı hiçbir kategoriye eşlemedi; bu kayıtlar «Sınıflandırılamayan kısa mesajlar» başlığında toplandı.",
    "LLM_REDUCE_PARTIAL_COVERAGE": "Kategori birleştirme ölçek sınırında tüm partileri ortak bir turda birleştiremedi; kayıtlar korunarak ayrı kategoriler bırakıldı.",
}
LABELS = {"total_rows": "Toplam satır", "analyzed_count": "Analiz edilen kayıt", "context_only_count": "Bağlam adayı (hedef dışı)", "discarded_count": "Elenen kayıt", "duplicate_count": "Tekrar eden kayıt", "unique_count": "Benzersiz kayıt", "redacted_count": "PII maskelenen kayıt"}
SHEETS = ("Özet", "Sorular", "Temalar")


def as_json(report: DataFrame) -> DataFrame:
    """(json) of each report, indented."""
    return report.select(F.to_json(F.struct(*report.columns), {"pretty": "true"}).alias("json"))


def question_sheet(top: DataFrame) -> DataFrame:
    text = formula_guard(F.col("canonical_question")).alias("question")
    return top.orderBy(F.desc("count"), "question_id").select("question_id", text, "count", "percentage", formula_guard(F.array_join("examples", "\n")).alias("examples"))


def theme_sheet(themes: DataFrame) -> DataFrame:
    return themes.orderBy(F.desc("count"), "theme_id").select(formula_guard(F.col("theme_id")).alias("theme_id"), formula_guard(F.col("name")).alias("name"), "count", "percentage", F.array_join("related", ", ").alias("related"))


@dataclass(frozen=True)
class About:
    """What a report says of its making: the request and file, the model with its tokens and cost, and its prices.

    tokens has the names of TOKENS, prices those of PRICES, in US dollars a million tokens; a
    missing cache price is shown as none. Without a price catalog there are no price rows.
    """

    request: Request
    analysis_id: str = ""
    generated_at: str = ""
    filename: str = ""
    sheet_name: str = ""
    model: str = ""
    prompt_version: str = ""
    prompt_hash: str = ""
    tokens: dict[str, int] = field(default_factory=dict)
    cost: float = 0.0
    cost_source: str = "snapshot"
    price_catalog: str | None = None
    prices: dict[str, float] = field(default_factory=dict)

    def before(self) -> list[tuple[str, int | float | str]]:
        """Rows above the counters."""
        r = self.request
        filters = "; ".join(f"{f.column} = {' | '.join(f.values)}" for f in r.filters)
        source = [(label, getattr(self, name)) for name, label in ABOUT.items()]
        return [*source, ("Kolon", r.text_column), ("Analiz biçimi", MODES[r.conversation is not None]), ("Satır filtreleri", filters or NONE)]

    def after(self) -> list[tuple[str, int | float | str]]:
        """Rows below the counters."""
        rows = [(label, getattr(self, name)) for name, label in USED.items()]
        rows += [(label, self.tokens.get(name, 0)) for name, label in TOKENS.items()]
        rows += [("Maliyet (USD)", self.cost), ("Maliyet kaynağı", COST_SOURCES[self.cost_source])]
        if c := self.request.conversation:
            values = {name: getattr(c, name) for name in CONVERSATION}
            rows += [(CONVERSATION[name], " | ".join(v) if isinstance(v, tuple) else v) for name, v in values.items()]
        if self.price_catalog is not None:
            rows += [("Fiyat kataloğu", self.price_catalog)] + [(label, NONE if (p := self.prices.get(name)) is None else p) for name, label in PRICES.items()]
        return rows


def summary_sheet(summary: DataFrame, executive: DataFrame, about: About | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """(label, number, text) in the order of the sheet: numbers stay numbers, texts are guarded, a row of nulls is blank.

    Rows of the making of the report come around the counters; warnings (code, n) close the
    sheet, each with its message, or its count where no message is fixed. A warning's code is
    one of a closed set, so warnings and settings are few rows.
    """
    spark = summary.sparkSession

    def told(pairs: list[tuple[str | None, int | float | str | None]], i: int) -> DataFrame:
        rows = [(i, j, k, None if isinstance(v, str) or v is None else float(v), v if isinstance(v, str) else None) for j, (k, v) in enumerate(pairs)]
        df = spark.createDataFrame(rows, "i int, j int, label string, number double, text string")
        return df.withColumn("text", formula_guard(F.col("text")))

    rows = F.array(*[F.struct(F.lit(1).alias("i"), F.lit(j).alias("j"), F.lit(label).alias("label"), F.col(c).cast("double").alias("number"), F.lit(None).cast("string").alias("text")) for j, (c, label) in enumerate(LABELS.items())])
    out = summary.select(F.explode(rows).alias("r")).select("r.*")
    text = executive.select(F.lit(4).alias("i"), F.lit(0).alias("j"), F.lit("Yönetici özeti").alias("label"), F.lit(None).cast("double").alias("number"), formula_guard(F.col("executive_summary")).alias("text"))
    if about is not None:
        out = out.unionByName(told(about.before(), 0)).unionByName(told(about.after(), 2))
    out = out.unionByName(told([(None, None)], 3)).unionByName(text)
    if warnings is not None:
        fixed = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
        message = F.replace(F.element_at(fixed, F.col("code")), F.lit("{n}"), F.col("n").cast("string"))
        place = F.row_number().over(W.orderBy("code"))
        found = warnings.select(F.lit(6).alias("i"), place.alias("j"), F.col("code").alias("label"), F.lit(None).cast("double").alias("number"), formula_guard(F.coalesce(message, F.col("n").cast("string"))).alias("text"))
        # The heading stands only above warnings.
        head = told([(None, None), WARNING_HEAD], 5).join(found.limit(1).select(F.lit(5).alias("i")), "i", "left_semi")
        out = out.unionByName(head).unionByName(found)
    return out.orderBy("i", "j").drop("i", "j")


def write_xlsx(path: str, summary: DataFrame, executive: DataFrame, top: DataFrame, themes: DataFrame, about: About | None = None, warnings: DataFrame | None = None) -> None:
    """Writes the workbook on the driver: a summary, the Top-N, and the themes streamed row by row."""
    whole = lambda n: int(n) if n.is_integer() else n
    pairs = ((r.label, whole(r.number) if r.number is not None else r.text) for r in summary_sheet(summary, executive, about, warnings).toLocalIterator())
    write_workbook(path, [(SHEETS[0], SUMMARY_HEAD, pairs), (SHEETS[1], QUESTION_HEAD, map(tuple, question_sheet(top).toLocalIterator())), (SHEETS[2], THEME_HEAD, map(tuple, theme_sheet(themes).toLocalIterator()))])
