"""Corrections of what readers of scanned Vietnamese reports misread in headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import replace_all

# Misread headings and their true forms, applied in this order.
MISREAD_HEADINGS = (
    ("CỔ PHẢN", "CỔ PHẦN"), ("CỎ PHẦN", "CỔ PHẦN"), ("CỎ PIIẦN", "CỔ PHẦN"), ("CỎ PIIÀN", "CỔ PHẦN"), ("CỎ PIẦN", "CỔ PHẦN"), ("CỎ PHẢN", "CỔ PHẦN"), ("CÔ PHẦN", "CỔ PHẦN"), ("CÔ PHAN", "CỔ PHẦN"),
    ("CỎ PHAN", "CỔ PHẦN"), ("CỔ PHAN", "CỔ PHẦN"), ("CỔ PHẨN", "CỔ PHẦN"), ("CỔ PHÀN", "CỔ PHẦN"), ("PIIẦN", "PHẦN"), ("PIIÀN", "PHẦN"), ("PIẦN", "PHẦN"),
    ("THƯÒNG NIÊN", "THƯỜNG NIÊN"), ("THUÒNG NIÊN", "THƯỜNG NIÊN"), ("THUONG NIÊN", "THƯỜNG NIÊN"), ("THUỜNG NIÊN", "THƯỜNG NIÊN"), ("THƯỞNG NIÊN", "THƯỜNG NIÊN"), ("THUONG NIEN", "THƯỜNG NIÊN"),
    ("THƯÒNG", "THƯỜNG"), ("THUÒNG", "THƯỜNG"), ("THUONG", "THƯỜNG"), ("THUỜNG", "THƯỜNG"), ("CÔNO TY", "CÔNG TY"), ("CONG TY", "CÔNG TY"), ("CÔNG TỸ", "CÔNG TY"), ("CỒNG TY", "CÔNG TY"),
    ("BÁO CÁ0", "BÁO CÁO"), ("BAO CAO", "BÁO CÁO"), ("BAO CÁO", "BÁO CÁO"), ("BÁO CA0", "BÁO CÁO"), ("DUỢC", "DƯỢC"), ("DUOC", "DƯỢC"), ("DUQC", "DƯỢC"), ("ĐUỢC", "ĐƯỢC"),
    ("Đuờng", "Đường"), ("Đja", "Địa"), ("Đia", "Địa"), ("Hả Nội", "Hà Nội"), ("NGUỜI", "NGƯỜI"), ("NGUOI", "NGƯỜI"), ("ĐỒNG VlỆT NAM", "ĐỒNG VIỆT NAM"), ("VIET NAM", "VIỆT NAM"), ("VIÊT NAM", "VIỆT NAM"),
    ("VlỆT NAM", "VIỆT NAM"), ("HỘI ĐỒNO", "HỘI ĐỒNG"), ("QUAN TRI", "QUẢN TRỊ"), ("BAN KIEM SOAT", "BAN KIỂM SOÁT"), ("TAI CHINH", "TÀI CHÍNH"), ("DOANH NGHIÊP", "DOANH NGHIỆP"), ("DOANH NGHIEP", "DOANH NGHIỆP"),
    ("0P ", "CP "), ("PHẢN DƯỢC", "PHẦN DƯỢC"), ("PHẨN ", "PHẦN "),
)
#: A misread phrase and a misread address.
PHRASE, ADDRESS = r"([Cc]ổ\s+[Pp])hản", r"http:[JIl/]+www"


def correct_headings(c: Column) -> Column:
    """Misread headings, the phrase and the address put right; null stays null."""
    out = F.regexp_replace(replace_all(c, MISREAD_HEADINGS), PHRASE, "$1hần")
    return F.regexp_replace(out, ADDRESS, "http://www")
