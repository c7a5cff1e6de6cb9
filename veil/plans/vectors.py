"""Texts with the value that a rule must find in them, or none; {n} stands for a number of six digits."""

from __future__ import annotations

VECTORS: dict[str, list[tuple[str, str | None]]] = {
    "EMAIL": [
        ("reach user{n}@mail.example.org today", "user{n}@mail.example.org"),
        ("a.b+c{n}@sub.shop.co.in", "a.b+c{n}@sub.shop.co.in"),
        ("The last one is x_{n}@y.net.", "x_{n}@y.net"),
        ("ask @support{n} please", None),
        ("root{n}@localhost only", None),
        ("<p{n}%q@r-s.io>", "p{n}%q@r-s.io"),
        ("über{n}@x.de", "ber{n}@x.de"),
        ("q@host.localhost", None),
    ],
    "PHONE": [
        ("call +91 98{n}12 now", "+91 98{n}12"),
        ("call +91-98{n}-12 now", "+91-98{n}-12"),
        ("call (555) 321-4{n} now", "321-4{n}"),
        ("call (555) 321-4567 now{n}", "(555) 321-4567"),
        ("call 555-321-4567 x89, {n}", "555-321-4567 x89"),
        ("call 555\t321\t4567 now", "555\t321\t4567"),
        ("ticket 98{n}12", None),
        ("Order No. 98{n}12", None),
        ("invoice # 98{n}12", None),
        ("12345\n67{n}", None),
        ("9876543210{n}9876543210", None),
        ("SKU_98{n}12_b", None),
        ("born no 98{n}12", "98{n}12"),
        ("+1 555 321 4567 ext. 12; {n}", "+1 555 321 4567 ext. 12"),
        ("it cost 1234 in all", None),
    ],
    "SSN": [
        ("my id, 219-09-9998, {n}", "219-09-9998"),
        ("my id, 219 09 9998, {n}", "219 09 9998"),
        ("my number 219-09-9998 is", None),
        ("{n}: 000-12-3456", None),
        ("{n}: 666-12-3456", None),
        ("{n}: 912-12-3456", None),
        ("{n}: 219-00-3456", None),
        ("{n}: 219-09-0000", None),
        ("receipt 219-09-9998", None),
        ("1219-09-9998", None),
    ],
    "CREDIT_CARD": [
        ("paid by 4111 1111 1111 1111 in {n}", "4111 1111 1111 1111"),
        ("paid by 5555-5555-5555-4444 in {n}", "5555-5555-5555-4444"),
        ("paid by 378282246310005 in {n}", "378282246310005"),
        ("paid by 4111 1111 1111 1112 in {n}", "4111 1111 1111 1112"),
        ("paid by 9999 9999 9999 9999 in {n}", None),
        ("paid by 41111111111111112 in {n}", None),
        ("Invoice 4111 1111 1111 1111 in {n}", None),
        ("paid by 6011000990139424 in {n}", "6011000990139424"),
        ("paid by 30569309025904 in {n}", "30569309025904"),
        ("paid by 3530111333300000 in {n}", "3530111333300000"),
        ("number 12345678901234567890 in {n}", None),
    ],
    "IP_ADDRESS": [
        ("host 10.20.30.40 up {n}", "10.20.30.40"),
        ("host 10.20.30.999 up {n}", None),
        ("host 010.20.30.40 up {n}", None),
        ("host 2001:db8::42 up {n}", "2001:db8::42"),
        ("host fe80:0:0:0:1:2:3:4 up {n}", "fe80:0:0:0:1:2:3:4"),
        ("at 2001:db8::1. Then {n}", "2001:db8::1"),
        ("any :: address {n}", None),
        ("any 0.0.0.0 address {n}", None),
        ("version 1.2.3.4 of {n}", None),
        ("Section 10.0.0.1 of {n}", None),
        ("v 1.2.3.4 of {n}", None),
        ("order 10.20.30.40 of {n}", None),
        ("1:2:3:4:5:6:7 is short {n}", None),
    ],
    "DOB": [
        ("born 12/03/1980, {n}", "12/03/1980"),
        ("DOB: 1980-03-12, {n}", "1980-03-12"),
        ("date of birth 7 July 1979, {n}", "7 July 1979"),
        ("Birthday July 7, 1979, {n}", "July 7, 1979"),
        ("birth date 7 Jul 1979, {n}", "7 Jul 1979"),
        ("born 31/02/1980, {n}", None),
        ("signed 12/03/1980, {n}", None),
        ("born 12/03/1800, {n}", None),
        ("born 12/03/2190, {n}", None),
        ("born 03/22/1980, {n}", "03/22/1980"),
        ("born 12-03-1980, {n}", "12-03-1980"),
        ("born 1/2/70, {n}", "1/2/70"),
    ],
    "ADDRESS": [
        ("at 48 Temple Street, Kochi 682011.", "48 Temple Street, Kochi 682011"),
        ("at Plot No. 12, Green Side, Pune {n}", "Plot No. 12, Green Side, Pune {n}"),
        ("at Flat 7 near the lake 560001;", "Flat 7 near the lake 560001"),
        ("at 48 Temple Street,\nKochi 682011.", None),
        ("at 48 Temple Kochi 682011", None),
        ("at 9 Old Industrial Estate Pune - 411001", "9 Old Industrial Estate Pune - 411001"),
        ("unit 3, west wing, 12345", "unit 3, west wing, 12345"),
        ("48 Streetwise people 682011", None),
    ],
    "FULL_NAME": [
        ("Contact Person: Ravi Kumar\n{n}", "Ravi Kumar"),
        ("Compliance Officer\nAnna Maria Lopez\n{n}", "Anna Maria Lopez"),
        ("Company Secretary : Leela O'Neil, {n}", "Leela O'Neil"),
        ("Contact Person: Website {n}", None),
        ("Contact Person: Ravi\n{n}", None),
        ("Contact Person: ravi kumar {n}", None),
        ("Contact Person: Ravi Kumar Email {n}", "Ravi Kumar"),
        ("The person Ravi Kumar {n}", None),
    ],
    "DOMAIN": [
        ("see www.site{n}.com now", "www.site{n}.com"),
        ("see https://www.site{n}.co.in/x", "https://www.site{n}.co.in"),
        ("see http://a.site{n}.org", "http://a.site{n}.org"),
        ("mail x@www.site{n}.com", None),
        ("see http://localhost/{n}", None),
        ("see www.site{n}. com now", "www.site{n}. com"),
        ("see www.site{n}.\u00a0com now", "www.site{n}.\u00a0com"),
        ("see www.sitename. Then {n}", "www.sitename"),
        ("see www.site{n}. Then", None),
        ("see www.site.{n}", None),
    ],
    "COMPANY": [
        ("with Blue Harbour Private Limited in {n}", "Blue Harbour Private Limited"),
        ("with Orchid & Sons Pvt Ltd in {n}", "Sons Pvt Ltd"),
        ("with Orchid Mills Pvt. Ltd. in {n}", "Orchid Mills Pvt. Ltd."),
        ("with Cedar Works LLP in {n}", "Cedar Works LLP"),
        ("from Taxable Income of {n}", None),
        ("an Incentive {n}", None),
        ("a private limited entity {n}", None),
        ("Our Company Limited {n}", None),
        ("with D-Mart Foods Inc {n}", "D-Mart Foods Inc"),
    ],
}
