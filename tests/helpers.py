"""Fixture builders: small payment CSV files in the newer or older layout."""

from __future__ import annotations

import csv

from paylens.constants import PAYMENT_COLUMN

NEW = "Covered_Recipient_"
OLD = "Physician_"
PI = "Principal_Investigator_"


def covered_row(first, last, amount, middle="", npi="", profile="", specialty="",
                prefix=NEW, pi=None):
    row = {
        f"{prefix}First_Name": first, f"{prefix}Middle_Name": middle,
        f"{prefix}Last_Name": last, f"{prefix}NPI": npi, f"{prefix}Profile_ID": profile,
        f"{prefix}Specialty_1": specialty,
    }
    for slot in (1,):
        row.update({f"{PI}{slot}_First_Name": "", f"{PI}{slot}_Middle_Name": "",
                    f"{PI}{slot}_Last_Name": "", f"{PI}{slot}_NPI": ""})
    for slot, (f, m, l, n) in (pi or {}).items():
        row.update({f"{PI}{slot}_First_Name": f, f"{PI}{slot}_Middle_Name": m,
                    f"{PI}{slot}_Last_Name": l, f"{PI}{slot}_NPI": n})
    row[PAYMENT_COLUMN] = amount
    return row


def pi_row(cov_first, cov_last, pi_first, pi_last, amount, pi_middle="", pi_npi=""):
    return covered_row(cov_first, cov_last, amount,
                       pi={1: (pi_first, pi_middle, pi_last, pi_npi)})


def write_csv(path, rows, columns=None):
    cols = columns or list(dict.fromkeys(k for r in rows for k in r))
    with open(path, "w", newline="", encoding="utf-8") as fh:
        w = csv.DictWriter(fh, fieldnames=cols, extrasaction="ignore")
        w.writeheader()
        for r in rows:
            w.writerow({c: r.get(c, "") for c in cols})
    return str(path)


def year_dir(tmp_path, files):
    """files: {year: rows} -> directory with <year>_rsh_payments.csv files."""
    for year, rows in files.items():
        write_csv(tmp_path / f"{year}_rsh_payments.csv", rows)
    return str(tmp_path)
