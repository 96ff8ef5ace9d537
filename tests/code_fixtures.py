"""Two small Go programs written for the tests (shapes described in
FIXTURES.md §3): "flat" (one package, four files) and "nested" (root package
in a sub-directory; four packages, one imported under another name)."""

FLAT = {
    "go.mod": "module flatdemo\n\ngo 1.21\n",
    "main.go": '''package main

import "fmt"

func main() {
\tg := NewGadget(Threshold)
\tg.Spin()
\th := Holder{inner: g}
\tfmt.Println(Describe(h), Fast, PrimaryB, Counter)
}
''',
    "funcs.go": '''package main

// Describe renders a holder { with braces in a comment }.
func Describe(h Holder) string {
\treturn "label: {" + h.Label() + "}"
}

func UnusedHelper() int {
\treturn 42
}
''',
    "types.go": '''package main

import "fmt"

type Gadget struct {
\tturns int
}

func NewGadget(n int) *Gadget {
\treturn &Gadget{turns: n}
}

func (g *Gadget) Spin() {
\tg.turns++
\tg.log()
}

func (g *Gadget) log() {
\t_ = fmt.Sprint(g.turns, '}')
}

type Holder struct {
\tinner *Gadget
}

func (h Holder) Label() string {
\treturn fmt.Sprint(h.inner.turns)
}

type UnusedShape struct{}

type Mode int

const (
\tSlow Mode = iota
\tFast
\tTurbo
)
''',
    "vars.go": '''package main

const Threshold = 7

const UnusedConst = "nope"

var (
\tCounter   = 1
\tUnusedVar = 2
)

var PrimaryA, PrimaryB = 10, 20

var describe =
\tfunc() string { return `raw } string` }
''',
    "vars_test.go": '''package main

func TestNothing() {}
''',
}

NESTED = {
    "go.mod": "module shopdemo\n",
    "app/run.go": '''package main

import (
\t"os"

\tstock "shopdemo/inventory"
\t"shopdemo/report"
)

func main() {
\tshelf := stock.Load(os.Args)
\tshelf.Add(stock.Crate, 4)
\treport.Print(os.Stdout, shelf)
}
''',
    "inventory/shelf.go": '''package inventory

import "shopdemo/money"

type Kind string

const (
\tCrate Kind = "crate"
\tSack  Kind = "sack"
)

const retired = "old"

type Shelf struct {
\tKind  Kind
\tcount map[Kind]int
}

func Load(args []string) *Shelf {
\treturn &Shelf{count: map[Kind]int{}}
}

func (s *Shelf) Add(k Kind, n int) {
\ts.count[k] += n
}

func (s *Shelf) Worth() money.Cents {
\treturn money.Of(len(s.count))
}

func Discard() {}
''',
    "money/money.go": '''package money

type Cents int

func Of(n int) Cents {
\treturn Cents(n * rate)
}

var rate = 100

var unusedRate = 7
''',
    "report/report.go": '''package report

import (
\t"fmt"
\t"io"

\t"shopdemo/internal/tbl"
\t"shopdemo/inventory"
)

func Print(w io.Writer, s *inventory.Shelf) {
\tfmt.Fprintln(w, tbl.Row("worth", int(s.Worth())))
}

func Load() {}
''',
    "internal/tbl/tbl.go": '''package tbl

import "strconv"

func Row(name string, n int) string {
\treturn name + ": " + strconv.Itoa(n)
}
''',
}


def as_rows(corpus_id: str, tree: dict[str, str]):
    """Rows (corpus_id, path, src) of the .go files (tests excluded)."""
    return [(corpus_id, p, s) for p, s in sorted(tree.items())
            if p.endswith(".go") and not p.endswith("_test.go")]


def manifest(corpus_id: str, tree: dict[str, str], root_pkg: str):
    module = [ln.split()[1] for ln in tree["go.mod"].splitlines() if ln.startswith("module ")][0]
    return (corpus_id, module, root_pkg)
