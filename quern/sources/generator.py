"""A deterministic table of chat messages of any size, for load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the seed of the generated table.
SEED = 20260814
COURSES = ("Matematik", "Fizik", "Kimya", "Biyoloji", "Tarih", "Coğrafya", "Felsefe", "İngilizce", "Almanca", "Programlama", "Veri Yapıları", "Mantık", "Çizge Kuramı", "Olasılık", "Ekonomi")
#: Questions with fields: {c} a course, {d} a date, {y} a year, {n} a number of seven digits, {p} points.
FORMS = (
    "{c} sınavı {d} günü mü yapılacak",
    "{c} notları ne zaman açıklanacak",
    "{c} dersini {y} yılında tekrar alabilir miyim",
    "Numaram {n}, {c} kaydım görünmüyor",
    "{c} dersinden {p} puan aldım, geçtim mi",
    "Harcımı {d} tarihine kadar yatırabilir miyim",
    "{y} bahar kaydı için ne gerekiyor",
    "Öğrenci numaram {n}, belgemi nasıl indiririm",
    "{c} ödevi hangi gün teslim edilecek",
    "{c} için kaynak önerir misiniz",
    "Yurt başvurusu {d} günü bitiyor mu",
    "Burs sonuçları {y} için belli oldu mu",
    "{c} laboratuvarı nerede yapılıyor",
    "Danışmanımla {d} günü görüşebilir miyim",
    "Kimliğimi kaybettim, numaram {n}",
    "{c} dersinde devam zorunlu mu",
    "Staj defterimi {d} tarihinde versem olur mu",
    "{c} bütünlemesine {p} puanla girebilir miyim",
    "Mezuniyet için {c} dersi sayılıyor mu",
    "Kütüphane {d} günü açık mı",
)


def chat_messages(spark: SparkSession, rows: int) -> DataFrame:
    """(row_ix, tarih, kullanici_id, mesaj, kanal, oturum_id, yanit_suresi_ms): each row follows from its number.

    20 questions and 15 courses, with dates, years, numbers and points, so that most texts differ but few questions do.
    """
    h = lambda salt: F.pmod(F.xxhash64(F.col("id"), F.lit(SEED + salt)), F.lit(1 << 31))
    pick = lambda values, salt: F.element_at(F.array(*[F.lit(v) for v in values]), (h(salt) % len(values) + 1).cast("int"))
    day = F.date_format(F.timestamp_seconds(F.lit(1_756_684_800) + h(7) % 400 * 86_400), "dd.MM.yyyy")
    fields = {"{c}": pick(COURSES, 2), "{d}": day, "{y}": (h(8) % 6 + 2021).cast("string"), "{n}": (h(9) % 9_000_000 + 1_000_000).cast("string"), "{p}": (h(10) % 101).cast("string")}
    message = pick(FORMS, 1)
    for mark, value in fields.items():
        message = F.replace(message, F.lit(mark), value)
    when = F.date_format(F.timestamp_seconds(F.lit(1_756_684_800) + F.col("id") * 60), "yyyy-MM-dd HH:mm:ss")
    return spark.range(rows).select(F.col("id").alias("row_ix"), when.alias("tarih"), F.format_string("u%06d", h(3) % 900_000 + 100_000).alias("kullanici_id"), message.alias("mesaj"), pick(("web", "mobil", "whatsapp", "telegram"), 4).alias("kanal"), F.format_string("s%010d", h(5)).alias("oturum_id"), (h(6) % 9_681 + 120).alias("yanit_suresi_ms"))
