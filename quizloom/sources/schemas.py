"""The schemas of the question bank's documents; optional fields are nullable."""

from __future__ import annotations

QUESTION = (
    "id string, sid string, n int, topic string, source string, stem string, options array<string>, answer array<int>, key string, flag string, "
    "`case` string, caseOpen boolean, chapter string, c array<string>, a string, dupOf string, rep int, cst int, om array<int>, pairs boolean, twinOf string, "
    "exp struct<lec:string,o:array<string>>, notes array<struct<html:string,src:string,w:int,h:int>>, stemImgs array<struct<src:string,w:int,h:int>>, "
    "qNotes array<struct<by:string,anchor:string,html:string>>, optNotes map<string,array<struct<anchor:string,html:string>>>"
)
SET = "id string, topic string, type string, year string, label string, added string, slug string"
CASE = "id string, html string"
TOPIC = "id string, name string"
REPEATS = "repeats array<struct<q:array<string>,s:int,v:int>>, dup map<string,string>"
CORRECTION = "q string, confirmed string, field string, `from` string, `to` string, why string, also map<string,string>, proposed string"
UPDATE = "id string, date string, title string, kind string, sets array<string>, types array<string>, questions array<string>, items array<string>"
SUGGESTIONS = "map<string,struct<answer:array<int>,why:string>>"
BANK = f"types array<string>, topics array<struct<{TOPIC}>>, sources array<struct<{SET}>>, cases array<struct<{CASE}>>, questions array<struct<{QUESTION}>>"
