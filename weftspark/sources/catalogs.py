"""Declared schemas of two well-known datasets, as DDL."""

from __future__ import annotations

from weftspark.plans.spec import Dataset
from weftspark.sources.ddl import read_ddl

# The TPC-H schema.
TPCH_DDL = """
create table region (r_regionkey integer primary key, r_name char(25) not null, r_comment varchar(152));
create table nation (n_nationkey integer primary key, n_name char(25) not null, n_regionkey integer not null references region(r_regionkey), n_comment varchar(152));
create table part (p_partkey integer primary key, p_name varchar(55), p_mfgr char(25), p_brand char(10), p_type varchar(25), p_size integer, p_container char(10), p_retailprice decimal(15,2), p_comment varchar(23));
create table supplier (s_suppkey integer primary key, s_name char(25), s_address varchar(40), s_nationkey integer references nation(n_nationkey), s_phone char(15), s_acctbal decimal(15,2), s_comment varchar(101));
create table partsupp (ps_partkey integer references part(p_partkey), ps_suppkey integer references supplier(s_suppkey), ps_availqty integer, ps_supplycost decimal(15,2), ps_comment varchar(199), primary key (ps_partkey, ps_suppkey));
create table customer (c_custkey integer primary key, c_name varchar(25), c_address varchar(40), c_nationkey integer references nation(n_nationkey), c_phone char(15), c_acctbal decimal(15,2), c_mktsegment char(10), c_comment varchar(117));
create table orders (o_orderkey integer primary key, o_custkey integer references customer(c_custkey), o_orderstatus char(1), o_totalprice decimal(15,2), o_orderdate date, o_orderpriority char(15), o_clerk char(15), o_shippriority integer, o_comment varchar(79));
create table lineitem (l_orderkey integer references orders(o_orderkey), l_partkey integer references part(p_partkey), l_suppkey integer references supplier(s_suppkey), l_linenumber integer, l_quantity decimal(15,2), l_extendedprice decimal(15,2), l_discount decimal(15,2), l_tax decimal(15,2), l_returnflag char(1), l_linestatus char(1), l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct char(25), l_shipmode char(10), l_comment varchar(44), primary key (l_orderkey, l_linenumber));
"""
# The public IMDB title files.
IMDB_DDL = """
create table title_basics (tconst text primary key, titleType text, primaryTitle text, originalTitle text, isAdult boolean, startYear integer, endYear integer, runtimeMinutes integer, genres text);
create table title_ratings (tconst text primary key references title_basics(tconst), averageRating real, numVotes integer);
create table title_crew (tconst text primary key references title_basics(tconst), directors text, writers text);
create table title_episode (tconst text primary key references title_basics(tconst), parentTconst text, seasonNumber integer, episodeNumber integer);
create table title_akas (titleId text references title_basics(tconst), ordering integer, title text, region text, language text, types text, attributes text, isOriginalTitle boolean, primary key (titleId, ordering));
create table name_basics (nconst text primary key, primaryName text, birthYear integer, deathYear integer, primaryProfession text, knownForTitles text);
create table title_principals (tconst text references title_basics(tconst), ordering integer, nconst text references name_basics(nconst), category text, job text, characters text, primary key (tconst, ordering));
"""


def tpch() -> Dataset:
    return read_ddl(TPCH_DDL)


def imdb() -> Dataset:
    return read_ddl(IMDB_DDL)
