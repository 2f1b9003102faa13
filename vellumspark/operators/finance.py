"""Statements in long form to firm-year ratios.

Facts are ``(ticker, year, item_code, value)``.  Base items are coalesced from ordered source codes, ratios are data:
name and SQL expression over base items; they are evaluated in two projections, not in 116 chained columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Base items and their source codes in order of preference; 'abs' marks items taken without sign.
BASE_ITEMS: dict[str, tuple[str, ...]] = {
    "total_assets": ("bs_tong_tai_san", "bs_tong_cong_tai_san"),
    "curr_assets": ("bs_tai_san_ngan_han", "bs_tong_tai_san_ngan_han"),
    "non_curr_assets": ("bs_tai_san_dai_han", "bs_tong_tai_san_dai_han"),
    "cash": ("bs_tien_va_tuong_duong_tien", "bs_tien_mat_vang_bac_da_quy", "bs_tien"),
    "st_invest": ("bs_gia_tri_thuan_dau_tu_ngan_han", "bs_dau_tu_ngan_han", "bs_chung_khoan_kinh_doanh", "bs_cac_tai_san_tai_chinh_ghi_nhan_thong_qua_lai_lo_fvtpl"),
    "receivables": ("bs_cac_khoan_phai_thu", "bs_phai_thu_khach_hang", "bs_tong_cac_khoan_phai_thu", "bs_phai_thu_cua_khach_hang"),
    "ar_cust": ("bs_phai_thu_khach_hang", "bs_phai_thu_cua_khach_hang"),
    "inventory": ("bs_hang_ton_kho_rong_746c904f", "bs_hang_ton_kho", "bs_hang_ton_kho_rong_fd969671", "bs_hang_ton_kho_2"),
    "fixed_assets": ("bs_tai_san_co_dinh", "bs_gtcl_tscd_huu_hinh", "bs_tai_san_co_dinh_huu_hinh"),
    "tangible_assets": ("bs_tai_san_co_dinh_huu_hinh", "bs_gtcl_tscd_huu_hinh", "bs_nguyen_gia_tscd_huu_hinh"),
    "invest_prop": ("bs_bat_dong_san_dau_tu",),
    "re_wip": ("bs_chi_phi_san_xuat_kinh_doanh_do_dang_dai_han", "bs_xay_dung_co_ban_do_dang", "bs_tai_san_do_dang_dai_han"),
    "total_debt": ("bs_no_phai_tra", "bs_tong_no_phai_tra"),
    "curr_liab": ("bs_no_ngan_han", "bs_tong_no_ngan_han"),
    "long_liab": ("bs_no_dai_han", "bs_tong_no_dai_han"),
    "st_debt": ("bs_vay_va_no_thue_tai_chinh_ngan_han", "bs_vay_ngan_han", "bs_vay_no_ngan_han", "bs_vay_tai_san_tai_chinh_ngan_han"),
    "lt_debt": ("bs_vay_va_no_thue_tai_san_tai_chinh_dai_han", "bs_vay_dai_han", "bs_vay_va_no_dai_han", "bs_trai_phieu_phat_hanh_dai_han"),
    "payables": ("bs_phai_tra_nguoi_ban_ngan_han", "bs_phai_tra_nguoi_ban"),
    "prepayments": ("bs_nguoi_mua_tra_tien_truoc_ngan_han", "bs_nguoi_mua_tra_tien_truoc", "bs_tra_truoc_ngan_han"),
    "equity": ("bs_von_chu_so_huu_4d280b22", "bs_von_chu_so_huu_6cda78ae", "bs_von_chu_so_huu", "bs_tong_von_chu_so_huu", "bs_von_va_cac_quy"),
    "charter_capital": ("bs_von_dieu_le", "bs_von_gop", "bs_von_dau_tu_cua_chu_so_huu"),
    "retained_earnings": ("bs_loi_nhuan_sau_thue_chua_phan_phoi", "bs_loi_nhuan_chua_phan_phoi", "bs_lai_chua_phan_phoi"),
    "revenue": ("is_doanh_so_thuan", "is_doanh_thu_thuan_ve_hoat_dong_kinh_doanh", "is_tong_thu_nhap_hoat_dong", "is_doanh_thu_hoat_dong", "is_doanh_thu_phi_bao_hiem_thuan", "is_thu_nhap_lai_thuan", "is_doanh_thu_thuan"),
    "cogs": ("abs", "is_gia_von_hang_ban", "is_gia_von"),
    "gross_profit": ("is_lai_gop", "is_loi_nhuan_gop", "is_loi_nhuan_gop_hoat_dong_kinh_doanh_bao_hiem"),
    "selling_exp": ("abs", "is_chi_phi_ban_hang", "is_chi_phi_ban_hang_truoc_2014"),
    "admin_exp": ("abs", "is_chi_phi_quan_ly_doanh_nghiep", "is_chi_phi_quan_ly_doanh_nghiep_lien_quan_truc_tiep_den_hoat_dong_bao_hiem", "is_chi_phi_quan_ly_cong_ty_chung_khoan"),
    "interest_exp": ("abs", "is_chi_phi_lai_vay", "is_trong_do_chi_phi_lai_vay", "is_chi_phi_lai_va_cac_khoan_chi_phi_tuong_tu", "is_chi_phi_lai_va_cac_chi_phi_tuong_tu", "cf_chi_phi_lai_vay"),
    "ebt": ("is_tong_loi_nhuan_ke_toan_truoc_thue", "is_tong_loi_nhuan_truoc_thue", "is_lai_lo_rong_truoc_thue", "is_loi_nhuan_truoc_thue", "is_lai_truoc_thue"),
    "eat": ("is_loi_nhuan_sau_thue_thu_nhap_doanh_nghiep", "is_lai_lo_thuan_sau_thue", "is_loi_nhuan_ke_toan_sau_thue", "is_loi_nhuan_sau_thue"),
    "eat_parent": ("is_loi_nhuan_cua_co_dong_cua_cong_ty_me", "is_loi_nhuan_sau_thue_cua_co_dong_cong_ty_me", "is_co_dong_cua_cong_ty_me", "is_loi_nhuan_sau_thue_cua_chu_so_huu_tap_doan"),
    "tax": ("abs", "is_chi_phi_thue_thu_nhap_doanh_nghiep", "is_chi_phi_thue_tndn_hien_hanh", "is_chi_phi_thue_thu_nhap_hien_hanh", "is_thue_thu_nhap_doanh_nghiep_hien_thoi"),
    "operating_profit": ("is_ebit", "is_lai_lo_tu_hoat_dong_kinh_doanh", "is_ln_thuan_tu_hoat_dong_kinh_doanh_truoc_cf_du_phong_rui_ro_tin_dung", "is_ket_qua_hoat_dong"),
    "ebit": ("is_ebit",),
    "ebitda": ("is_ebitda",),
    "cfo": ("cf_luu_chuyen_tien_thuan_tu_cac_hoat_dong_san_xuat_kinh_doanh", "cf_luu_chuyen_thuan_tu_hoat_dong_kinh_doanh_chung_khoan", "cf_luu_chuyen_tien_thuan_tu_hoat_dong_kinh_doanh", "cf_luu_chuyen_tien_thuan_tu_hoat_dong_kinh_doanh_truoc_thue_thu_nhap_dn"),
    "cfi": ("cf_luu_chuyen_tien_te_rong_tu_hoat_dong_dau_tu", "cf_luu_chuyen_tien_thuan_tu_hoat_dong_dau_tu", "cf_luu_chuyen_tu_hoat_dong_dau_tu"),
    "cff": ("cf_luu_chuyen_tien_te_tu_hoat_dong_tai_chinh", "cf_luu_chuyen_tien_tu_hoat_dong_tai_chinh", "cf_luu_chuyen_thuan_tu_hoat_dong_tai_chinh", "cf_luu_chuyen_tien_thuan_tu_hoat_dong_tai_chinh"),
    "capex": ("abs", "cf_tien_chi_de_mua_sam_xay_dung_tscd_va_cac_tai_san_dai_han_khac", "cf_tien_chi_mua_sam_xay_dung_tscd_va_cac_tai_san_dai_han_khac", "cf_tien_mua_tai_san_co_dinh_va_cac_tai_san_dai_han_khac"),
    "bank_loans": ("bs_cho_vay_khach_hang", "bs_cho_vay_khach_hang_2"),
    "bank_deposits": ("bs_tien_gui_cua_khach_hang", "bs_tien_gui_cua_khach_hang_va_cac_to_chuc_tin_dung_khac"),
    "bank_nii": ("is_thu_nhap_lai_thuan",),
    "bank_toi": ("is_tong_thu_nhap_hoat_dong",),
    "bank_provisions": ("abs", "bs_du_phong_rui_ro_cho_vay_khach_hang", "bs_du_phong_rui_ro_tin_dung"),
    "bank_credit_cost_item": ("abs", "is_chi_phi_du_phong_rui_ro_tin_dung"),
    "bank_opex": ("abs", "is_chi_phi_hoat_dong", "is_chi_phi_quan_ly_doanh_nghiep"),
    "sec_margin": ("bs_cho_vay_va_ung_truoc_cho_khach_hang", "bs_cho_vay_va_ung_truoc_cho_vay", "bs_cac_khoan_cho_vay"),
    "sec_advances": ("bs_phai_thu_ung_truoc_tien_ban_chung_khoan_cua_khach_hang", "bs_ung_truoc_tien_ban"),
    "sec_fvtpl": ("bs_cac_tai_san_tai_chinh_ghi_nhan_thong_qua_lai_lo_fvtpl",),
    "sec_afs": ("bs_cac_khoan_tai_chinh_san_sang_de_ban_afs",),
    "sec_htm": ("bs_cac_khoan_dau_tu_nam_giu_den_ngay_dao_han_htm",),
    "sec_broker_rev": ("is_doanh_thu_hoat_dong_moi_gioi_chung_khoan",),
    "sec_broker_cost": ("abs", "is_chi_phi_moi_gioi_chung_khoan"),
    "sec_prop_rev": ("is_lai_tu_cac_tai_san_tai_chinh_ghi_nhan_thong_qua_lai_lo_fvtpl",),
    "sec_margin_profit": ("is_lai_tu_cac_khoan_cho_vay_va_phai_thu",),
    "sec_ib_rev": ("is_doanh_thu_hoat_dong_tu_van_tai_chinh", "is_doanh_thu_bao_lanh_phat_hanh_chung_khoan"),
    "sec_oper_cost": ("abs", "is_chi_phi_hoat_dong_kinh_doanh", "is_chi_phi_hoat_dong"),
    "sec_prop_cost": ("abs", "is_chi_phi_hoat_dong_tu_doanh"),
    "sec_provision_cost": ("abs", "is_chi_phi_du_phong_tstc", "is_chi_phi_du_phong"),
}
# Ratios by group; 'a / b' is null where b is null or zero, z(x) is x or zero.
RATIOS: dict[str, dict[str, str]] = {
    "profitability": {
        "roa": "eat / total_assets", "roe": "eat / equity", "roce": "ebit / (total_assets - curr_liab)", "roic": "ebit * (1 - coalesce(tax / ebt, 0.2)) / (equity + z(fin_debt) - z(cash))",
        "gross_margin": "gross_profit / revenue", "operating_margin": "ebit / revenue", "ebitda_margin": "ebitda / revenue", "net_margin": "eat / revenue", "ebt_margin": "ebt / revenue",
        "effective_tax_rate": "tax / ebt", "dupont_tax_burden": "eat / ebt", "dupont_interest_burden": "ebt / ebit", "dupont_operating_margin": "ebit / revenue",
        "dupont_asset_turnover": "revenue / total_assets", "dupont_equity_multiplier": "total_assets / equity",
    },
    "leverage": {
        "debt_to_assets": "total_debt / total_assets", "debt_to_equity": "total_debt / equity", "fin_debt_to_assets": "fin_debt / total_assets", "fin_debt_to_equity": "fin_debt / equity",
        "equity_to_assets": "equity / total_assets", "equity_multiplier": "total_assets / equity", "st_debt_to_total_debt": "st_debt / fin_debt", "lt_debt_to_total_debt": "lt_debt / fin_debt",
        "interest_coverage": "ebit / interest_exp", "debt_to_ebitda": "fin_debt / ebitda", "cfo_to_debt": "cfo / fin_debt", "cfo_to_liabilities": "cfo / total_debt", "fin_leverage_ratio": "total_assets / equity",
    },
    "liquidity": {
        "current_ratio": "curr_assets / curr_liab", "quick_ratio": "(curr_assets - z(inventory)) / curr_liab", "cash_ratio": "(z(cash) + z(st_invest)) / curr_liab", "cash_to_assets": "cash / total_assets",
        "working_capital": "nwc", "nwc_to_assets": "nwc / total_assets", "nwc_to_revenue": "nwc / revenue", "defensive_interval": "(z(cash) + z(ar_cust)) * 365 / coalesce(sga, cogs, 0)",
    },
    "activity": {
        "asset_turnover": "revenue / total_assets", "fixed_asset_turnover": "revenue / fixed_assets", "inventory_turnover": "cogs / inventory", "dio": "inventory * 365 / cogs",
        "ar_turnover": "revenue / ar_cust", "dso": "ar_cust * 365 / revenue", "ap_turnover": "cogs / payables", "dpo": "payables * 365 / cogs",
        "ccc": "(inventory * 365 / cogs) + (ar_cust * 365 / revenue) - (payables * 365 / cogs)", "working_capital_turnover": "revenue / nwc", "sga_to_revenue": "sga / revenue",
        "selling_cost_ratio": "selling_exp / revenue", "admin_cost_ratio": "admin_exp / revenue",
    },
    "cash_flow": {
        "cfo_to_net_income": "cfo / eat", "cfo_to_revenue": "cfo / revenue", "cfo_to_assets": "cfo / total_assets", "cfo_to_equity": "cfo / equity", "fcf": "cfo - z(capex)",
        "fcf_to_net_income": "(cfo - z(capex)) / eat", "fcf_to_revenue": "(cfo - z(capex)) / revenue", "capex_to_revenue": "capex / revenue", "capex_to_assets": "capex / total_assets",
        "cfo_to_capex": "cfo / capex", "accruals_to_assets": "(eat - cfo) / total_assets",
    },
    "banks": {
        "bank_nim": "bank_nii / total_assets", "bank_cir": "bank_opex / bank_toi", "bank_ldr": "bank_loans / bank_deposits", "bank_provision_coverage": "bank_provisions / bank_loans",
        "bank_credit_cost": "bank_credit_cost_item / bank_loans", "bank_loans_to_assets": "bank_loans / total_assets", "bank_deposits_to_assets": "bank_deposits / total_assets",
        "bank_equity_to_assets": "equity / total_assets", "bank_nii_to_toi": "bank_nii / bank_toi", "bank_non_interest_income_ratio": "(bank_toi - bank_nii) / bank_toi",
    },
    "securities": {
        "margin_to_equity": "sec_margin / equity", "pct_margin_loans": "sec_margin / total_assets", "pct_advances": "sec_advances / total_assets", "pct_fvtpl": "sec_fvtpl / total_assets",
        "pct_afs": "sec_afs / total_assets", "pct_htm": "sec_htm / total_assets", "pct_cash": "cash / total_assets", "pct_brokerage_rev": "sec_broker_rev / revenue", "pct_proprietary_rev": "sec_prop_rev / revenue",
        "pct_margin_profit": "sec_margin_profit / revenue", "pct_ib_rev": "sec_ib_rev / revenue", "pct_brokerage_cost": "sec_broker_cost / sec_oper_cost",
        "pct_proprietary_cost": "sec_prop_cost / sec_oper_cost", "pct_provision_cost": "sec_provision_cost / sec_oper_cost",
    },
    "real_estate": {
        "re_prepayments_to_inventory": "prepayments / inventory", "re_prepayments_to_assets": "prepayments / total_assets", "re_inventory_to_assets": "inventory / total_assets",
        "re_wip_to_assets": "re_wip / total_assets", "re_debt_to_inventory": "fin_debt / inventory", "re_invest_prop_to_assets": "invest_prop / total_assets",
    },
    "growth": {
        f"{name}_yoy": f"yoy({item})"
        for name, item in (
            ("rev_growth", "revenue"), ("gross_profit_growth", "gross_profit"), ("ebit_growth", "ebit"), ("ebt_growth", "ebt"), ("eat_growth", "eat"), ("eat_parent_growth", "eat_parent"),
            ("assets_growth", "total_assets"), ("equity_growth", "equity"), ("debt_growth", "total_debt"), ("fin_debt_growth", "fin_debt"), ("cfo_growth", "cfo"),
            ("bank_loans_growth", "bank_loans"), ("bank_deposits_growth", "bank_deposits"), ("margin_loans_growth", "sec_margin"),
        )
    },
    "econometric": {
        "size_ln": "case when total_assets > 0 then ln(total_assets) end", "size_log10": "case when total_assets > 0 then log10(total_assets) end", "tangibility": "tangible_assets / total_assets",
        "firm_age_proxy": "retained_earnings / total_assets", "altman_x1": "nwc / total_assets", "altman_x2": "retained_earnings / total_assets", "altman_x3": "ebit / total_assets",
        "altman_x4": "equity / total_debt", "altman_x5": "revenue / total_assets",
        "altman_z_prime": "0.717D * (nwc / total_assets) + 0.847D * (retained_earnings / total_assets) + 3.107D * (ebit / total_assets) + 0.420D * (equity / total_debt) + 0.998D * (revenue / total_assets)",
        "charter_capital_to_equity": "charter_capital / equity", "retained_earnings_to_equity": "retained_earnings / equity",
    },
}
PRESETS = {
    "basic": ("roa", "roe", "net_margin", "debt_to_assets", "current_ratio", "size_ln"),
    "profitability": tuple(RATIOS["profitability"]), "solvency": (*RATIOS["leverage"], *RATIOS["liquidity"]), "banking": tuple(RATIOS["banks"]),
    "securities": tuple(RATIOS["securities"]), "full": tuple(n for g in RATIOS.values() for n in g),
}


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero or the result is no finite number."""
    q = F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))
    return F.when(F.isnan(q) | (F.abs(q) == float("inf")), F.lit(None)).otherwise(q)


def pivot_facts(facts: DataFrame, codes: list[str], order: Column | None = None) -> DataFrame:
    """One row per (ticker, year), one column per code of the explicit list; the first non-null value by ``order`` counts.

    A single aggregation with an explicit list: the schema is fixed and no job looks for the codes.
    """
    order = F.col("value") if order is None else order
    kept = facts.where(F.col("item_code").isin(*codes) & F.col("value").isNotNull())
    return kept.groupBy("ticker", "year").agg(*[F.min_by(F.when(F.col("item_code") == c, F.col("value")), F.when(F.col("item_code") == c, order)).alias(c) for c in codes])


def codes_of(pattern: str, columns: list[str]) -> list[str]:
    """Columns that a code names: itself first, then those that contain it, in their order."""
    same = [c for c in columns if c.lower() == pattern.lower()]
    return same + [c for c in columns if pattern.lower() in c.lower() and c not in same]


def base_items(wide: DataFrame) -> DataFrame:
    """(ticker, year) with every base item; an item without any source column is null."""
    columns = [c for c in wide.columns if c not in ("ticker", "year")]
    out = {}
    for item, patterns in BASE_ITEMS.items():
        absolute = patterns[0] == "abs"
        found = list(dict.fromkeys(c for p in patterns[absolute:] for c in codes_of(p, columns)))
        c = F.coalesce(*[F.col(x).cast("double") for x in found]) if found else F.lit(None).cast("double")
        out[item] = F.abs(c) if absolute else c
    first = wide.select("ticker", "year", *[c.alias(k) for k, c in out.items()])
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    either = lambda a, b: F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), z(a) + z(b))
    derived = first.withColumns({
        "ar_cust": F.coalesce("ar_cust", "receivables"), "fin_debt": either("st_debt", "lt_debt"), "sga": either("selling_exp", "admin_exp"),
        "gross_profit": F.coalesce(F.col("gross_profit"), F.col("revenue") - F.col("cogs")), "eat_parent": F.coalesce("eat_parent", "eat"), "nwc": F.col("curr_assets") - F.col("curr_liab"),
    })
    derived = derived.withColumn("ebit", F.coalesce(F.col("ebit"), F.col("ebt") + z("interest_exp"), F.col("operating_profit"), F.col("gross_profit") - F.col("sga")))
    return derived.withColumn("ebitda", F.coalesce("ebitda", "ebit"))


def yoy(item: str, strict: bool = False) -> Column:
    """Change against the ticker's row before, over its absolute value; ``strict`` wants the year just before."""
    w = Window.partitionBy("ticker").orderBy("year")
    before = F.lag(item).over(w)
    if strict:
        before = F.when(F.col("year") - F.lag("year").over(w) == 1, before)
    return safe_div(F.col(item) - before, F.abs(before))


def _expression(formula: str) -> str:
    """SQL of a formula: every '/' becomes a null-safe division, z(x) a zero for null."""
    import re

    out = re.sub(r"\bz\((\w+)\)", r"coalesce(\1, 0D)", formula)

    def operand(text: str, at: int, step: int) -> int:
        """The far end of the operand that begins at ``at`` and runs in direction ``step``."""
        depth, i = 0, at
        while 0 <= i < len(text):
            c = text[i]
            if c in "()":
                depth += 1 if (c == "(") == (step > 0) else -1
                if depth < 0:
                    break
                if depth == 0 and step > 0 and c == ")":
                    return i + 1
                if depth == 0 and step < 0 and c == "(":
                    j = i - 1
                    while j >= 0 and (text[j].isalnum() or text[j] == "_"):
                        j -= 1
                    return j + 1
            elif depth == 0 and not (c.isalnum() or c in "_."):
                if not (step > 0 and c == "(") and not c == " ":
                    break
                if c == " ":
                    break
            i += step
        return i if step > 0 else i + 1

    while " / " in out:
        at = out.index(" / ")
        left = operand(out, at - 1, -1)
        right = operand(out, at + 3, 1)
        # multiplication binds as tightly: the product before the slash is the dividend
        while out[:left].endswith(" * "):
            left = operand(out, left - 4, -1)
        out = f"{out[:left]}try_divide({out[left:at]}, nullif({out[at + 3 : right]}, 0))" + out[right:]
    return out


def ratios(base: DataFrame, names: list[str] | None = None, strict_yoy: bool = False) -> DataFrame:
    """(ticker, year) with the named ratios (all by default): one projection over the base items."""
    known = {n: f for g in RATIOS.values() for n, f in g.items()}
    names = list(known) if names is None else names
    out = []
    for n in names:
        f = known[n]
        c = yoy(f[4:-1], strict_yoy) if f.startswith("yoy(") else F.expr(_expression(f)).cast("double")
        out.append(F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c).alias(n))
    return base.select("ticker", "year", *out)


def available_ratios(codes: list[str]) -> dict[str, bool]:
    """Whether each ratio's base items can be found among the codes."""
    import re

    have = {item: any(codes_of(p, codes) for p in patterns if p != "abs") for item, patterns in BASE_ITEMS.items()}
    have |= {"fin_debt": have["st_debt"] or have["lt_debt"], "sga": have["selling_exp"] or have["admin_exp"], "nwc": have["curr_assets"] and have["curr_liab"]}
    have["ebit"] = have["ebit"] or have["ebt"] or have["operating_profit"] or have["gross_profit"]
    have["ebitda"] = have["ebitda"] or have["ebit"]
    have["ar_cust"] = have["ar_cust"] or have["receivables"]
    have["eat_parent"] = have["eat_parent"] or have["eat"]
    needs = lambda f: {w for w in re.findall(r"[a-z_][a-z_0-9]*", re.sub(r"\bz\(\w+\)", "", f)) if w in have}
    return {n: all(have[w] for w in needs(f)) for g in RATIOS.values() for n, f in g.items()}


def nonempty_codes(facts: DataFrame) -> DataFrame:
    """Item codes with some value that is neither null nor zero: found in long form, before any pivot."""
    return facts.where(F.col("value").isNotNull() & (F.col("value") != 0)).select("item_code").distinct()


def statements_of(codes: list[str]) -> list[str]:
    """Statements (partitions) that a list of codes needs: pruned by the codes' prefixes."""
    by = {"bs_": "balance_sheet", "is_": "income_statement", "cf_": "cash_flow"}
    return sorted({by[c[:3]] for c in codes if c[:3] in by})


def lookup(facts: DataFrame, aliases: list[str], name: str) -> DataFrame:
    """(ticker, year, name): the first non-null value in the order of the aliases."""
    rank = F.array_position(F.array(*[F.lit(a) for a in aliases]), F.col("item_code"))
    return facts.where(F.col("item_code").isin(*aliases) & F.col("value").isNotNull()).groupBy("ticker", "year").agg(F.min_by("value", rank).alias(name))


def grid(tickers: DataFrame, first: int, last: int) -> DataFrame:
    """Every ticker with every year of a span: one row per ticker exploded, no join."""
    return tickers.select("ticker").distinct().select("ticker", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))


def upsert_facts(old: DataFrame, new: DataFrame, order: Column | None = None) -> DataFrame:
    """Facts with the rows of updating tickers replaced: of each (ticker, year, item_code) the first row by ``order``.

    Without an order of arrival the least value counts as the first, so that the result depends on no partitioning.
    """
    keys = ["ticker", "year", "item_code"]
    order = F.col("value") if order is None else order
    kept = old.join(new.select("ticker").distinct(), "ticker", "left_anti")
    rows = kept.unionByName(new, allowMissingColumns=True)
    return rows.groupBy(*keys).agg(F.min_by("value", order).alias("value"))


def identity_check(wide: DataFrame, assets: str, resources: str, debt: str, equity: str) -> DataFrame:
    """(ticker, year, gap, balanced): assets against resources, else debt and equity; a gap under 1 or 0.1 % is balanced."""
    other = F.coalesce(F.col(resources), F.col(debt) + F.col(equity))
    gap = F.abs(F.col(assets) - other)
    return wide.select("ticker", "year", gap.alias("gap"), ((gap < 1.0) | (gap < 0.001 * F.abs(F.col(assets)))).alias("balanced"))


# Accounting groups and what an item's code contains to belong there, in order.
ITEM_GROUPS = (
    ("cash flow, operations", ("hoat_dong_kinh_doanh", "san_xuat_kinh_doanh"), "cf_"), ("cash flow, investing", ("dau_tu", "mua_sam"), "cf_"), ("cash flow, financing", ("tai_chinh", "vay", "co_tuc"), "cf_"), ("cash flow, other", ("",), "cf_"),
    ("revenue", ("doanh_thu", "doanh_so", "thu_nhap"), "is_"), ("costs", ("gia_von", "chi_phi"), "is_"), ("profit", ("loi_nhuan", "lai_", "ebit"), "is_"), ("income, other", ("",), "is_"),
    ("equity", ("von_chu", "von_gop", "von_dieu", "loi_nhuan", "quy"), "bs_"), ("debt", ("no_", "vay", "phai_tra"), "bs_"), ("current assets", ("ngan_han", "tien", "ton_kho", "phai_thu"), "bs_"), ("long-term assets", ("dai_han", "co_dinh", "bat_dong_san"), "bs_"), ("balance, other", ("",), "bs_"),
)


def item_group(code: Column) -> Column:
    """The accounting group of an item code: the first group that fits."""
    out = F.lit("other")
    for name, parts, prefix in reversed(ITEM_GROUPS):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(code, F.lit(p))
        out = F.when(F.startswith(code, F.lit(prefix)) & hit, F.lit(name)).otherwise(out)
    return out


def latest_facts(facts: DataFrame, order: Column) -> DataFrame:
    """(ticker, year, item_code, value): one value each, the non-null one that comes last by ``order``."""
    return facts.where(F.col("value").isNotNull()).groupBy("ticker", "year", "item_code").agg(F.max_by("value", order).alias("value"))


def balance_repair(wide: DataFrame, assets: str, debt: str, equity: str) -> DataFrame:
    """Total assets of zero become debt and equity together, where one of them is known."""
    both = F.coalesce(F.col(debt), F.lit(0.0)) + F.coalesce(F.col(equity), F.lit(0.0))
    empty = F.coalesce(F.col(assets), F.lit(0.0)) == 0
    return wide.withColumn(assets, F.when(empty & (both != 0), both).otherwise(F.col(assets)))


def master_items(facts: DataFrame, items: DataFrame) -> DataFrame:
    """(statement_order, item_order, item_code, n): every code that occurs, in the catalog's order; unknown ones come last by their code."""
    seen = facts.groupBy("item_code").agg(F.count("value").alias("n"))
    last = F.lit(2**31 - 1)
    return seen.join(items, "item_code", "left").select(F.coalesce("statement_order", last).alias("statement_order"), F.coalesce("item_order", last).alias("item_order"), "item_code", "n").orderBy("statement_order", "item_order", "item_code")


def with_base(metrics: DataFrame, base: DataFrame, items: list[str]) -> DataFrame:
    """Metrics with the base items that they lack; a metric named like a base item stands for it."""
    extra = [c for c in items if c not in metrics.columns]
    return metrics.join(base.select("ticker", "year", *extra), ["ticker", "year"], "left")


# The ratios of a provider's panel over its own five variables.
PROVIDER_RATIOS = {"roa": "net_income / total_assets", "roe": "net_income / total_equity", "size": "ln(total_assets)", "leverage": "total_debt / total_assets", "current_ratio": "total_assets / total_debt"}


def provider_panel(facts: DataFrame, tickers: DataFrame, first: int, last: int, codes: dict[str, str]) -> DataFrame:
    """(ticker, year, five variables, five ratios) for every firm and year of a span; a ratio with a missing or zero part is null."""
    wide = pivot_facts(facts, list(codes.values())).select("ticker", "year", *[F.col(c).alias(n) for n, c in codes.items()])
    panel = grid(tickers, first, last).join(wide, ["ticker", "year"], "left")

    def ratio(formula: str) -> Column:
        if formula.startswith("ln("):
            c = F.col(formula[3:-1])
            return F.when(c > 0, F.ln(c))
        a, b = formula.split(" / ")
        return safe_div(F.col(a), F.col(b))

    return panel.select("*", *[F.round(ratio(f), 6).alias(n) for n, f in PROVIDER_RATIOS.items()])


#: A name is taken for a template's from this share of common characters on.
NAME_ALIKE = 0.78


def match_templates(names: DataFrame, templates: DataFrame) -> DataFrame:
    """(year, name, item_code, similarity): names equal to a template's of their year, else the most similar one from NAME_ALIKE on.

    Only distinct names without an equal one are compared, with the templates of their year, which are a fixed list of some
    hundred; ties fall to the first template by name.
    """
    from .matching import indel_ratio

    distinct = names.where("name is not null").select("year", "name").distinct()
    same = distinct.join(templates.select("year", "name", "item_code"), ["year", "name"]).groupBy("year", "name").agg(F.min("item_code").alias("item_code")).withColumn("similarity", F.lit(1.0))
    listed = templates.groupBy("year").agg(F.array_sort(F.collect_set(F.struct("name", "item_code"))).alias("t"))

    @F.pandas_udf("struct<item_code:string,similarity:double>")
    def nearest(name: pd.Series, t: pd.Series) -> pd.DataFrame:
        out = []
        for x, options in zip(name, t, strict=True):
            best = max(((indel_ratio(x, o["name"]), -k) for k, o in enumerate(options)), default=(0.0, 0))
            out.append((options[-best[1]]["item_code"], best[0]) if best[0] >= NAME_ALIKE else (None, None))
        return pd.DataFrame(out, columns=["item_code", "similarity"])

    rest = distinct.join(same.select("year", "name"), ["year", "name"], "left_anti").join(listed, "year")
    near = rest.select("year", "name", nearest("name", "t").alias("m")).where("m.item_code is not null")
    return same.unionByName(near.select("year", "name", "m.item_code", F.round("m.similarity", 4).alias("similarity")))
