"""One source template per language and the symbols it must yield.

``{i}`` stands for the document id. Expected rows were derived by hand:
(kind, name, line, end_line, n, source, alias, tag), lines relative to the code,
which follows the document's own text rendered as line comments.
"""

COMMENT = {
    "python": "# ", "javascript": "// ", "solidity": "// ", "go": "// ", "rust": "// ", "java": "// ",
    "cpp": "// ", "ruby": "# ", "php": "// ", "swift": "// ", "kotlin": "// ", "dart": "// ",
    "lua": "-- ", "elixir": "# ", "zig": "// ", "shell": "# ", "nim": "# ", "scala": "// ",
    "objc": "// ", "erlang": "% ",
}


def _i(name, line, source=None, alias=None):
    return ("import", name, line, None, None, source, alias, None)


def _f(name, line, end, n):
    return ("function", name, line, end, n, None, None, None)


def _c(name, line, end, n):
    return ("class", name, line, end, n, None, None, None)


def _v(name, line, tag="module"):
    return ("variable", name, line, None, None, None, None, tag)


def _x(name, line, tag):
    return ("export", name, line, None, None, None, None, tag)


def _k(name, line):
    return ("call", name, line, None, None, None, None, None)


TEMPLATES: dict[str, tuple[str, list[tuple]]] = {}

TEMPLATES["go"] = ("""package main
import (
	"fmt"
	str "strings"
)
var limit{i} = 3
type Node{i} struct {
	id int
}
func (n *Node{i}) Run(a int, b int) {
	if a > b {
		fmt.Println(n.id)
	}
}
func helper{i}() int {
	return str.Count("x", "y")
}
const (
	Top{i} = 1
	low{i} = 2
)
""", [
    _k("import", 2), _i("fmt", 3, "fmt"), _i("strings", 4, "strings", "str"),
    _v("limit{i}", 6), _c("Node{i}", 7, 9, 1), _x("Node{i}", 7, "class"),
    _f("Node{i}.Run", 10, 14, 2), _x("Node{i}.Run", 10, "function"), _k("Run", 10),
    _k("fmt.Println", 12), _f("helper{i}", 15, 17, 0), _k("helper{i}", 15), _k("str.Count", 16),
    _k("const", 18), _v("Top{i}", 19), _x("Top{i}", 19, "variable"), _v("low{i}", 20),
])

TEMPLATES["rust"] = ("""use std::{io, fs as files};
use core::cell::Cell;
pub struct Node{i} {
    id: i32,
}
impl Node{i} {
    pub fn make(id: i32) -> Node{i} {
        build(id)
    }
    fn inner(&self, xs: Vec<(i32)>) {
        println!("x");
    }
}
pub const LIMIT{i}: i32 = 3;
fn free{i}<T>(a: T, b: Pair<i32, i32>) {
    Cell::new(a);
}
""", [
    _i("io", 1, "std::io"), _i("fs", 1, "std::fs", "files"), _i("Cell", 2, "core::cell::Cell"),
    _c("Node{i}", 3, 5, 2), _x("Node{i}", 3, "class"),
    _f("Node{i}.make", 7, 9, 1), _x("Node{i}.make", 7, "function"), _k("make", 7), _k("build", 8),
    _f("Node{i}.inner", 10, 12, 2), _k("inner", 10), _k("println", 11),
    _v("LIMIT{i}", 14), _x("LIMIT{i}", 14, "variable"), _f("free{i}", 15, 17, 2), _k("Cell::new", 16),
])

TEMPLATES["java"] = ("""package app;
import java.util.List;
import static java.lang.Math.abs;
/* a block
   comment { */
public class Node{i} {
    private static final int LIMIT = 3;
    private List<String> names = new ArrayList(4);
    public Node{i}(int a) {
        this.a = a;
    }
    public int run(int a, String b) throws Error {
        if (a > 1) { return util.go(b); } // } not code
        return abs(a);
    }
    abstract void later();
}
""", [
    _i("List", 2, "java.util.List"), _i("abs", 3, "java.lang.Math.abs", "static"),
    _c("Node{i}", 6, 17, 4), _x("Node{i}", 6, "class"),
    _v("LIMIT", 7, "class"), _v("names", 8, "class"), _k("new ArrayList", 8),
    _f("Node{i}", 9, 11, 1), _x("Node{i}", 9, "function"),
    _f("run", 12, 15, 2), _x("run", 12, "function"), _k("run", 12), _k("util.go", 13),
    # "return abs(a);" has the shape of an abstract method
    _f("abs", 14, 14, 1), _x("abs", 14, "function"), _k("abs", 14),
    _f("later", 16, 16, 0), _x("later", 16, "function"), _k("later", 16),
])

TEMPLATES["cpp"] = ("""#include <vector>
#include "node{i}.h"
using namespace std;
using std::string;
class Node{i} : public Base {
public:
    int size(int a) const {
        return helper(a); /* } */
    }
};
int Node{i}::total(int a, int b) {
    return this->inner(a) + ns::go(b);
}
static int hidden{i}(void) {
    return 1;
}
static int counter{i} = 0;
int shared{i} = 4;
""", [
    _i("vector", 1, "vector"), _i("node{i}.h", 2, "node{i}.h"), _i("std", 3, "std"),
    _i("std::string", 4, "std::string"),
    _v("std", 3), _x("std", 3, "variable"),
    _c("Node{i}", 5, 10, 2), _x("Node{i}", 5, "class"),
    _f("size", 7, 9, 1), _x("size", 7, "function"), _k("size", 7), _k("helper", 8),
    _f("Node{i}::total", 11, 13, 2), _x("Node{i}::total", 11, "function"), _k("Node{i}::total", 11),
    _k("this->inner", 12), _k("ns::go", 12),
    _f("hidden{i}", 14, 16, 0), _k("hidden{i}", 14),
    # "return 1;" has the shape of a declaration
    _v("1", 15), _x("1", 15, "variable"),
    _v("counter{i}", 17), _v("shared{i}", 18), _x("shared{i}", 18, "variable"),
])

TEMPLATES["ruby"] = ("""require 'json'
require_relative 'lib/store{i}'
=begin
def commented
=end
LIMIT = 3
class Node{i}
  include Comparable
  @@count = 0
  @shared = 1
  def run(a, b)
    @inner = a
    if a
      go(b)
    end
  end
  def self.make{i}
    Node{i}.new # note
  end
  private
  def hidden{i}
    items.each do |x|
      x.call(1)
    end
  end
end
""", [
    _i("json", 1, "json"), _i("store{i}", 2, "lib/store{i}"), _v("LIMIT", 6),
    _c("Node{i}", 7, 26, 3), _x("Node{i}", 7, "class"), _i("Comparable", 8),
    _v("@@count", 9, "class"), _v("@shared", 10, "class"),
    _f("run", 11, 16, 2), _x("run", 11, "function"), _k("run", 11), _k("go", 14),
    _f("self.make{i}", 17, 19, 0), _x("self.make{i}", 17, "function"), _k("Node{i}.new", 18),
    _f("hidden{i}", 21, 25, 0), _k("x.call", 23),
])

TEMPLATES["php"] = ("""<?php
use App\\Models\\User as Account;
require_once 'lib/store{i}.php';
abstract class Node{i}
{
    private static $cache = 1;
    const LIMIT = 3;
    public function run($a, $b)
    {
        return $this->go($a); /* {
        } */
    }
}
function helper{i}()
{
    return Account::find(1);
}
""", [
    _i("User", 2, "App\\Models\\User", "Account"), _i("store{i}.php", 3, "lib/store{i}.php"),
    _c("Node{i}", 4, 13, 1), _x("Node{i}", 4, "class"), _v("$cache", 6, "class"), _v("LIMIT", 7, "class"),
    _f("run", 8, 12, 2), _x("run", 8, "function"), _k("run", 8), _k("go", 10), _k("go", 10),
    _f("helper{i}", 14, 17, 0), _x("helper{i}", 14, "function"), _k("helper{i}", 14),
    _k("Account::find", 16), _k("find", 16),
])

TEMPLATES["swift"] = ("""import Foundation
@testable import Store{i}
let shared{i} = 1
private var hidden{i} = 2
public struct Node{i} {
    var id: Int = 0
    init(id: Int) {
        self.id = id
    }
    private func inner<T>(a: T, b: Int) {
        go(b)
    }
    deinit {
    }
}
func helper{i}() -> Int {
    return Store.count(1)
}
""", [
    _i("Foundation", 1, "Foundation"), _i("Store{i}", 2, "Store{i}"),
    _v("shared{i}", 3), _x("shared{i}", 3, "variable"), _v("hidden{i}", 4),
    _c("Node{i}", 5, 15, 2), _x("Node{i}", 5, "class"), _v("id", 6, "class"), _x("id", 6, "variable"),
    _f("init", 7, 9, 1), _x("init", 7, "function"),
    _f("inner", 10, 12, 2), _k("go", 11),
    _f("deinit", 13, 14, 0), _x("deinit", 13, "function"),
    _f("helper{i}", 16, 18, 0), _x("helper{i}", 16, "function"), _k("helper{i}", 16), _k("Store.count", 17),
])

TEMPLATES["kotlin"] = ("""package app
import kotlin.math.abs as mabs
import app.Store{i}
const val LIMIT{i} = 3
private val hidden{i} = 4
data class Node{i}(val id: Int) {
    internal fun inner(a: Int, b: Int): Int {
        return mabs(a)
    }
    fun short(a: Int) = a
}
fun helper{i}() {
    Store{i}.load(1)
}
""", [
    _i("abs", 2, "kotlin.math.abs", "mabs"), _i("Store{i}", 3, "app.Store{i}"),
    _v("LIMIT{i}", 4), _x("LIMIT{i}", 4, "variable"), _v("hidden{i}", 5),
    _c("Node{i}", 6, 11, 2), _x("Node{i}", 6, "class"), _v("id", 6), _x("id", 6, "variable"), _k("Node{i}", 6),
    _f("inner", 7, 9, 2), _k("mabs", 8),
    _f("short", 10, 10, 1), _x("short", 10, "function"), _k("short", 10),
    _f("helper{i}", 12, 14, 0), _x("helper{i}", 12, "function"), _k("helper{i}", 12), _k("Store{i}.load", 13),
])

TEMPLATES["dart"] = ("""import 'package:app/store{i}.dart' as st;
export 'src/api{i}.dart';
/* two
lines */
final int limit{i} = 3;
String title{i} = "x";
class Node{i} {
  final int id;
  int get size => 1;
  void run(int a, {int b, int c}) {
    st.load(a);
  }
  int _hidden() => go(1);
}
int helper{i}(int a) {
  return a;
}
""", [
    _i("store{i}", 1, "package:app/store{i}.dart", "st"), _i("api{i}", 2, "src/api{i}.dart"),
    _x("api{i}", 2, "default"),
    _v("limit{i}", 4), _x("limit{i}", 4, "variable"), _v("title{i}", 5), _x("title{i}", 5, "variable"),
    _c("Node{i}", 6, 13, 3), _x("Node{i}", 6, "class"), _v("id", 7, "class"),
    _f("size", 8, 8, 0), _x("size", 8, "function"),
    # braces of named parameters close first
    _f("run", 9, 9, 2), _x("run", 9, "function"), _k("st.load", 10),
    _f("_hidden", 12, 12, 0), _k("int", 12), _k("go", 12),
    _f("helper{i}", 14, 16, 1), _x("helper{i}", 14, "function"), _k("int", 14),
])

TEMPLATES["lua"] = ("""local json = require("lib.json")
local M = {}
--[==[ two
lines ]==]
M.limit = 3
count{i} = 0
function M.run(a, b)
  if a then
    return json.encode(b)
  end
end
local helper{i} = function(x)
  print(x)
end
function M:late()
  return 1
end
return M
""", [
    _i("json", 1, "lib.json", "json"), _v("json", 1), _v("M", 2), _k("require", 1), _k("lib.json", 1),
    _v("M.limit", 4), _x("limit", 4, "variable"), _v("count{i}", 5),
    _f("M.run", 6, 10, 2), _x("run", 6, "function"), _k("M.run", 6), _k("json.encode", 8),
    _f("helper{i}", 11, 13, 1), _k("print", 12),
    _f("M:late", 14, 16, 0), _x("late", 14, "function"), _k("M:late", 14),
])

TEMPLATES["elixir"] = ("""defmodule App.Node{i} do
  use GenServer
  alias App.{Store{i}, Cache}
  alias App.Util.Text
  import Enum
  require Logger
  @limit 3
  def run(a, b) do
    if a do
      Text.trim(b) |> Cache.put
    end
  end
  defp hidden{i}(x), do: x
  def plain{i} do
    hidden{i}(1) # note
  end
end
""", [
    _c("App.Node{i}", 1, 17, 3), _x("App.Node{i}", 1, "class"), _i("GenServer", 2, "GenServer"),
    _i("App.Store{i}", 3, "App", "Store{i}"), _i("App.Cache", 3, "App", "Cache"),
    _i("App.Util.Text", 4, "App.Util.Text", "Text"), _i("Enum", 5, "Enum"), _i("Logger", 6, "Logger"),
    _v("@limit", 7), _f("run", 8, 12, 2), _x("run", 8, "function"), _k("run", 8),
    _k("Text.trim", 10), _k("Cache.put", 10),
    _f("hidden{i}", 13, 13, 1), _k("hidden{i}", 13),
    _f("plain{i}", 14, 16, 0), _x("plain{i}", 14, "function"), _k("hidden{i}", 15),
])

TEMPLATES["zig"] = ("""const std = @import("std");
const cfg = @import("config.zig");
pub const Node{i} = struct {
    id: u32,
    pub fn run(self: Node{i}, a: u32) u32 {
        const inner = helper{i}(a);
        return inner;
    }
};
var counter{i}: u32 = 0;
pub const limit{i} = 3;
fn helper{i}(a: u32) u32 {
    return std.math.max(a, @intCast(a));
}
""", [
    _i("std", 1, "std", "std"), _i("conf", 2, "config.zig", "cfg"),
    _k("@import", 1), _k("@import", 2),
    _c("Node{i}", 3, 9, 1), _x("Node{i}", 3, "class"),
    _f("run", 5, 8, 2), _x("run", 5, "function"), _k("helper{i}", 6),
    _v("counter{i}", 10), _v("limit{i}", 11), _x("limit{i}", 11, "variable"),
    _f("helper{i}", 12, 14, 1), _k("std.math.max", 13), _k("@intCast", 13),
])

TEMPLATES["shell"] = ("""#!/bin/bash
source ./lib/store{i}.sh
. "conf/env{i}.sh"
export LIMIT{i}=3
count=0 # note ${#count}
run{i}() {
  local inner=1
  if [ "$1" = "}" ]; then
    echo $(date +%s)
  fi
}
function stop-it{i} {
  run{i} "$@"
}
run{i} `hostname` 'x # y'
""", [
    _i("store{i}.sh", 2, "./lib/store{i}.sh"), _i("env{i}.sh", 3, "conf/env{i}.sh"),
    _v("LIMIT{i}", 4), _x("LIMIT{i}", 4, "variable"), _v("count", 5), _x("count", 5, "variable"),
    _f("run{i}", 6, 11, 0), _x("run{i}", 6, "function"), _k("run{i}", 6), _v("inner", 7, "function"),
    _k("date", 9), _f("stop-it{i}", 12, 14, 0), _x("stop-it{i}", 12, "function"), _k("stop-it{i}", 12),
    _k("run{i}", 13), _k("run{i}", 15), _k("hostname", 15),
])

TEMPLATES["nim"] = ("""import std/strutils
from os import walkDir, getEnv
#[ block
  comment ]#
const limit{i}* = 3
var
  first{i}: int
  second{i}* = 2
type
  Node{i}* = object
    id: int
proc run{i}*(n: Node{i}, a, b: int): int =
  let inner = helper(a)

  result = inner
proc late{i}() =
  strutils.strip("x")
type Kind{i} = enum
  one, two
""", [
    _i("strutils", 1, "std/strutils"), _i("walkDir", 2, "os"), _i("getEnv", 2, "os"),
    _v("limit{i}", 5), _x("limit{i}", 5, "variable"), _v("first{i}", 7), _v("second{i}", 8),
    _x("second{i}", 8, "variable"),
    _c("Node{i}", 10, 11, 1), _x("Node{i}", 10, "class"),
    _f("run{i}", 12, 15, 1), _x("run{i}", 12, "function"), _v("inner", 13, "function"), _k("helper", 13),
    _f("late{i}", 16, 17, 0), _k("late{i}", 16), _k("strutils.strip", 17),
    _c("Kind{i}", 18, 19, 0),
])

TEMPLATES["scala"] = ("""package app
import scala.collection.mutable
import app.store.{Store{i}, Cache => Kept}
import app.util._
/* gone
with its newline */
object Node{i} {
  val limit = 3
  private def inner(a: Int, f: (Int, Int) => Int): Int = {
    val deep = new Store{i}(a)
    f(a, 1)
  }
  def short(a: Int) = go(a)
}
trait Shape{i} {
  def area: Int
}
""", [
    _i("mutable", 2, "scala.collection"), _i("Store{i}", 3, "app.store"), _i("Cache", 3, "app.store", "Kept"),
    _i("_", 4, "app.util"),
    _c("Node{i}", 6, 13, 2), _x("Node{i}", 6, "class"), _v("limit", 7), _x("limit", 7, "variable"),
    _f("inner", 8, 11, 2), _x("inner", 8, "function"), _k("inner", 8), _v("deep", 9, "class"),
    _k("Store{i}", 9), _k("f", 10), _f("short", 12, 12, 1), _x("short", 12, "function"), _k("short", 12),
    _k("go", 12), _c("Shape{i}", 14, 16, 1), _x("Shape{i}", 14, "class"),
    _f("area", 15, 15, 0), _x("area", 15, "function"),
])

TEMPLATES["objc"] = ("""#import <Foundation/Foundation.h>
#import "Node{i}.h"
@import UIKit;
static NSString *const kName{i} = @"x";
@interface Node{i} (Extra) 
@property (nonatomic, strong) NSString *title;
- (void)run:(int)a with:(int)b;
@end
@implementation Node{i}
- (void)run:(int)a with:(int)b {
    [self stop];
    NSLog(a);
}
+ (int)_hidden
{
    return 1;
}
@end
static int helper{i}(int a, int b) {
    return a;
}
""", [
    _i("Foundation.h", 1, "Foundation/Foundation.h"), _i("Node{i}.h", 2, "Node{i}.h"), _i("UIKit", 3, "UIKit"),
    _v("kName{i}", 4), _x("kName{i}", 4, "variable"),
    _c("Node{i}(Extra)", 5, 8, 1), _x("Node{i}(Extra)", 5, "class"), _v("title", 6, "class"),
    _f("run:with:", 7, 13, 2), _x("run:with:", 7, "function"),
    _c("Node{i}", 9, 18, 2), _x("Node{i}", 9, "class"),
    _f("run:with:", 10, 13, 2), _x("run:with:", 10, "function"),
    _k("[self stop]", 11), _k("NSLog", 12), _f("_hidden", 14, 17, 0),
    _k("Node{i}", 5),
    _f("helper{i}", 19, 21, 2), _x("helper{i}", 19, "function"), _k("helper{i}", 19),
])
# "- (void)run…;" on line 7 has its next "{" three lines below, on line 10, so only a
# brace within two lines would extend it: the declaration ends where it starts.
TEMPLATES["objc"][1][8] = _f("run:with:", 7, 7, 2)
# "@property (" reads as a C call of ``property``.
TEMPLATES["objc"][1].append(_k("property", 6))

TEMPLATES["erlang"] = ("""-module(node{i}).
-include("store{i}.hrl").
-import(lists, [map/2, seq/2]).
-export([run/2, late/0]).
-define(LIMIT, 3).
run([A, B], C) ->
    lists:map(A, C),
    go(B);
run(A, _) when A > 1 ->
    ok.
late() ->
    hidden{i}({a, b}).
hidden{i}({X, Y}) ->
    X + Y.
""", [
    _i("node{i}", 1), _i("store{i}.hrl", 2, "store{i}.hrl"), _i("map", 3, "lists"), _i("seq", 3, "lists"),
    _x("run", 4, "function"), _x("late", 4, "function"), _v("LIMIT", 5),
    _f("run", 6, 10, 2), _k("run", 6), _k("lists:map", 7), _k("go", 8), _k("run", 9),
    _f("late", 11, 12, 0), _k("late", 11), _k("hidden{i}", 12),
    _f("hidden{i}", 13, 14, 1), _k("hidden{i}", 13),
])

TEMPLATES["solidity"] = ("""pragma solidity 0.8;
import {Store, Cache as Kept} from "./Store{i}.sol";
import * as Lib from "./Lib.sol";
import "./Plain.sol";
import "./Named.sol" as Named;
contract Node{i} {
    uint256 public total{i};
    mapping(address => uint) private held;
    constructor(uint a) {
        total{i} = a;
    }

    function run(uint a, uint b) public returns (uint) {
        emit Done(a);
        return Lib.add(a, b);
    }
}
interface Shape{i} {
    function area() external;
}
""", [
    _i("Store", 2, "./Store{i}.sol"), _i("Cache", 2, "./Store{i}.sol", "Kept"), _i("*", 3, "./Lib.sol", "Lib"),
    _i("*", 4, "./Plain.sol"), _i("*", 5, "./Named.sol", "Named"),
    _c("Node{i}", 6, 17, 2), _x("Node{i}", 6, "class"), _v("total{i}", 7), _v("held", 8),
    _f("constructor", 9, 11, 1), _k("constructor", 9),
    _f("run", 12, 16, 2), _x("run", 12, "function"), _k("run", 13), _k("Done", 14), _k("Lib.add", 15),
    _c("Shape{i}", 18, 20, 1), _x("Shape{i}", 18, "class"),
    _f("area", 19, 21, 0), _x("area", 19, "function"), _k("area", 19),
])

TEMPLATES["python"] = ("""import os
import a.b as c
from . import near
from lib.store{i} import load as ld, save
X{i}, _y = 1, 2
try:
    import hidden
except ImportError:
    pass
class Node{i}:
    def run(self, a, *rest, key=1, **more):
        return self.go(a).stop()
    async def _late(self):
        pass
def helper{i}(a, /, b):
    def nested():
        return ld(b)
    return os.path.join(a, b)
Z{i}: int = 3
""", [
    _i("os", 1), _i("a.b", 2, None, "c"), _i("near", 3, ""), _i("load", 4, "lib.store{i}", "ld"),
    _i("save", 4, "lib.store{i}"), _v("X{i}", 5), _v("_y", 5),
    _c("Node{i}", 10, 14, 2), _f("run", 11, 12, 5), _f("_late", 13, 14, 1),
    _f("helper{i}", 15, 18, 2), _v("Z{i}", 19),
    _x("run", 11, "function"), _x("helper{i}", 15, "function"), _x("Node{i}", 10, "class"),
    _x("X{i}", 5, "variable"), _x("Z{i}", 19, "variable"),
    _k("stop", 12), _k("self.go", 12), _k("os.path.join", 18), _k("ld", 17),
])

TEMPLATES["javascript"] = ("""import React, { useState as use, memo } from 'react';
import * as path from "path";
import './style{i}.css';
import {
  load,
  save as keep,
} from './store{i}';
const fs = require('fs');
export const limit{i} = 3;
/* block { */
export default function Main{i}(a, { b, c }) {
  const inner = use(1);
  return `${keep(a)} text (x)`;
}
const arrow{i} = async (x, y) => {
  await path.join(x, "call(me)");
};
const tiny{i} = x => load(x);
class Node{i} extends Base {
  constructor(a) {
    super(a);
  }
  static async run(a, b) {
    this.stop();
    return new Thing(fs.read(a)).then(b);
  }
}
function helper{i}() { return /call\\(me\\)/.test(limit{i}); }
export { helper{i}, arrow{i} as other };
export class Shape{i} {}
const one{i} = 1, { left, right: other } = load(one{i}), twice{i} = (p, q) => p * q;
export let first{i} = [1, 2],
  second{i} = { a: 1, b: [2] };
export async function wide{i}(
  one: string,
  { two, three } = {},
  four = load(2),
): void {
  load(one)
    .then((r) => {
      return keep(r);
    })
    .catch(save(1)).finally();
}
const late{i} = async (
  x,
  y,
) => {
  fs.read({
    x: 1,
  }).then(y);
};
const text{i} = `a ${use(1)}
  b ${load(2)}`.trim(), rule{i} = /[/(]call(me)/g;
const os = require('os'), net = require("net");
const sum{i} = (
  use(1) + 2
);
class Wide{i} {
  constructor(
    private a: A,
    b,
  ) {
    this.stop();
  }
}
""", [
    _i("React", 1, "react"), _i("useState", 1, "react", "use"), _i("memo", 1, "react"),
    _i("*", 2, "path", "path"), _i("*", 3, "./style{i}.css"),
    _i("load", 4, "./store{i}"), _i("save", 4, "./store{i}", "keep"), _i("fs", 8, "fs"),
    _v("fs", 8), _k("require", 8), _v("limit{i}", 9), _x("limit{i}", 9, "variable"),
    _f("Main{i}", 11, 14, 2), _x("Main{i}", 11, "default"), _k("use", 12), _k("keep", 13),
    _f("arrow{i}", 15, 17, 2), _k("path.join", 16), _f("tiny{i}", 18, 18, 0), _k("load", 18),
    _c("Node{i}", 19, 27, 2), _f("constructor", 20, 22, 1), _f("run", 23, 26, 2),
    _k("stop", 24), _k("fs.read", 25), _k("then", 25),
    _f("helper{i}", 28, 28, 0), _k("test", 28),
    _x("helper{i}", 29, "variable"), _x("arrow{i}", 29, "variable"),
    _c("Shape{i}", 30, 30, 0), _x("Shape{i}", 30, "class"),
    _v("one{i}", 31), _v("{ left, right: other }", 31), _k("load", 31), _f("twice{i}", 31, 31, 2),
    _v("first{i}", 32), _v("second{i}", 32), _x("first{i}", 32, "variable"), _x("second{i}", 32, "variable"),
    _f("wide{i}", 34, 44, 3), _x("wide{i}", 34, "function"), _k("load", 37), _k("load", 39), _k("then", 39),
    _k("keep", 41), _k("catch", 39), _k("save", 43), _k("finally", 39),
    _f("late{i}", 45, 52, 2), _k("fs.read", 49), _k("then", 49),
    _v("text{i}", 53), _k("use", 53), _k("load", 54), _k("trim", 54), _v("rule{i}", 53),
    _i("os", 55, "os"), _i("net", 55, "net"), _v("os", 55), _v("net", 55), _k("require", 55), _k("require", 55),
    _v("sum{i}", 56), _k("use", 57), _c("Wide{i}", 59, 66, 1), _f("constructor", 60, 65, 2), _k("stop", 64),
])
