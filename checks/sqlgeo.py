"""Text builders for rectangle arithmetic in the check SQL."""


def w(a): return f"greatest({a}.r-{a}.l,0)"
def h(a): return f"greatest({a}.b-{a}.t,0)"
def area(a): return f"({w(a)}*{h(a)})"
def cx(a): return f"(({a}.l+{a}.r)//2)"
def cy(a): return f"(({a}.t+{a}.b)//2)"
def ox(a, b): return f"greatest(least({a}.r,{b}.r)-greatest({a}.l,{b}.l),0)"
def oy(a, b): return f"greatest(least({a}.b,{b}.b)-greatest({a}.t,{b}.t),0)"
def inter(a, b): return f"({ox(a, b)}*{oy(a, b)})"
def gx(a, b): return f"greatest(greatest({a}.l,{b}.l)-least({a}.r,{b}.r),0)"
def gy(a, b): return f"greatest(greatest({a}.t,{b}.t)-least({a}.b,{b}.b),0)"
def union_area(a, b): return f"({area(a)}+{area(b)}-{inter(a, b)})"
def min_area(a, b): return f"least({area(a)},{area(b)})"
def dcx(a, b): return f"abs({cx(a)}-{cx(b)})"
def dcy(a, b): return f"abs({cy(a)}-{cy(b)})"
def holds(o, i, m=0): return f"({cx(i)} BETWEEN {o}.l-{m} AND {o}.r+{m} AND {cy(i)} BETWEEN {o}.t-{m} AND {o}.b+{m})"
def iou_over(a, b, p): return f"({inter(a, b)}*100 > {p}*{union_area(a, b)})"
def cont_over(a, b, p): return f"({inter(a, b)}*100 > {p}*{min_area(a, b)})"
def covered(a, b, p): return f"({area(a)}>0 AND {inter(a, b)}*100 >= {p}*{area(a)})"
